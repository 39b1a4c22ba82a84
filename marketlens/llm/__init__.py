"""Operators of a training-data pipeline, each a Spark job over documents, pages or vectors.

Nothing outside this folder imports it. Every operator keeps its state in
tasks and shuffles; only values with a stated size bound reach the driver.
"""
