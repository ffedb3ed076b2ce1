"""Governed question-answering data work as Spark jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (frame to
frame), ``sources`` (tables, footers, snapshots, evaluation sets), ``plans``
(several operators run as one job), ``streaming`` (incremental session log) and
``workload`` (the registered queries).
"""
