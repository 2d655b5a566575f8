"""Reading and writing corpora, queries, ground truth, statistics and tables."""

from .files import load_corpus, load_queries, read_ground_truth, read_lines, read_strings, read_vectors
from .fvecs import read_fvecs, write_fvecs
from .sinks import publish_table, write_ground_truth, write_statistics
from .tables import corpus, default_queries, part_corpus

__all__ = ["corpus", "default_queries", "load_corpus", "load_queries", "part_corpus", "publish_table", "read_fvecs", "read_ground_truth", "read_lines", "read_strings", "read_vectors", "write_fvecs", "write_ground_truth", "write_statistics"]
