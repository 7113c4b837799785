"""exemplar: few-shot example retrieval, prompt assembly and evaluation
analytics expressed as Spark DataFrame jobs.

Layout
------
sources/    readers and writers (corpus JSONL, index Parquet, summaries, sinks)
functions/  Column-level building blocks (vector maths, code features, text)
operators/  DataFrame -> DataFrame operators (top-k search, BM25, rerank, ...)
plans/      end-to-end jobs wired from the operators
streaming/  incremental (file-arrival) variants
"""

__version__ = "0.1.0"
