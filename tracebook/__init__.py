"""Evidence-traceable knowledge analytics on PySpark.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``streaming``
(Structured Streaming operators), ``plans`` (the registered queries) and the
optional ``llm`` (training-data operators, which nothing else imports).
"""
