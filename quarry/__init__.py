"""quarry: retrieval and question answering over document tables, on Spark.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``sources``   - file trees, web pages and the supplied tables as documents
* ``functions`` - column expressions (vectors, text, cache keys, formatting)
* ``operators`` - chunking, embedding, kNN joins, rerank, prompts, answers,
                  answer cache, metrics
* ``plans``     - end-to-end batch plans and the registered driver queries
* ``streaming`` - Structured Streaming forms of question intake, ingest,
                  TTL cache and live metrics
"""

__version__ = "0.1.0"
