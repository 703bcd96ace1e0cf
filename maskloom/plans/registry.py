"""All queries outside the corpus operators, by name, with SQL for those that SQL can express."""

from . import cell_queries, compare_queries, detection_queries, evaluation_queries, join_queries, label_queries, page_queries, value_queries
from .detection_queries import mask_documents

_PARTS = (detection_queries, value_queries, join_queries, evaluation_queries, cell_queries, label_queries, page_queries, compare_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = mask_documents
