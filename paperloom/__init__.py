"""Document-intelligence analytics on Spark.

``functions`` holds Column factories, ``operators`` the per-document and relational
operators, ``sources`` readers and writers, ``plans`` the registered queries and their
SQL, ``streaming`` the continuous variants.
"""
