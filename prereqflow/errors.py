"""Errors that are part of the contract."""

# Messages that callers compare.
NOT_FOUND = "Concept with ID '{}' was not found in the graph."
DUPLICATE = "Concept with ID '{}' already exists in the graph."
SELF_LOOP = "Self-loop detected: Concept '{}' cannot be a prerequisite of itself."
NO_EDGE = "Dependency from '{}' to '{}' does not exist."
CYCLE = "Circular dependency cycle detected in graph: {}"


class GraphError(Exception):
    pass


class ConceptNotFound(GraphError):
    def __init__(self, concept_id: str):
        self.concept_id = concept_id
        super().__init__(NOT_FOUND.format(concept_id))


class DuplicateConcept(GraphError):
    def __init__(self, concept_id: str):
        self.concept_id = concept_id
        super().__init__(DUPLICATE.format(concept_id))


class InvalidDependency(GraphError):
    pass


class SelfLoop(InvalidDependency):
    def __init__(self, concept_id: str):
        self.concept_id = concept_id
        super().__init__(SELF_LOOP.format(concept_id))


class CycleDetected(GraphError):
    def __init__(self, cycle_path: list[str]):
        self.cycle_path = cycle_path
        super().__init__(CYCLE.format(" -> ".join(cycle_path)))
