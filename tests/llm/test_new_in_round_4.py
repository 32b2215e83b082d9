"""What round 4 found."""

import random

from prereqflow.llm import decontamination as D
from prereqflow.llm.decontamination import clean, contaminated


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_that_hold_a_window_are_shuffled(spark, monkeypatch):
    """Many windows and many contaminated documents: texts without any stay where they are, those of null ids and of a repeated id too."""
    rng = random.Random(41)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(n))
    item = words(20)
    rows = [(i, words(3), words(1500)) for i in range(300)] + [(1000 + i, "x", f"{words(9)} {item} {words(9)}") for i in range(40)]
    rows += [(7, "x", f"{item} {words(5)}"), (None, "x", item), (1003, "x", words(60))]
    docs, items = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4), spark.createDataFrame([(1, item)], "item_id long, text string")
    docs.count()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 25)
    stored = docs.localCheckpoint()
    before = shuffled(spark)
    hit = {*range(1000, 1040), 7}
    assert {(r.doc_id, r.item_id) for r in contaminated(stored, items).collect()} == {(i, 1) for i in hit}
    kept = [(r.doc_id, r.lang, r.text) for r in clean(stored, items).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[0] not in hit], key=str)
    assert shuffled(spark) - before < 1_000_000  # the texts are 6 MB
