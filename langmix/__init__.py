"""langmix: multilingual corpus, language-ID and evaluation jobs on Spark.

Layout
------
functions/  Column -> Column helpers (codes, text cleaning, tokenisation, labels)
sources/    readers, sinks and the driver's fixture tables
operators/  DataFrame -> DataFrame jobs (corpus, ranking, pairs, code-switch,
            detection, learning, metrics)
plans/      the registered query keys and their SQL oracles
streaming/  Structured Streaming ingest / profile / evaluation
"""

__all__ = ["session"]
