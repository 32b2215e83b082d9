"""Prerequisite analytics on Spark: course outlines to concept graphs, and questions over them."""
