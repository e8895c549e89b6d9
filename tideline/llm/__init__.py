"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with
its own interface; :mod:`tideline.llm.queries` registers the thin queries.
"""

import os

# A task has a core; more threads inside numpy would only compete with other tasks. Takes effect if numpy isn't loaded yet.
os.environ.setdefault("OMP_NUM_THREADS", "1")
