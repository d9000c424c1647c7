"""Operations of a training-data pipeline, one module per operator.

Nothing outside this package imports it; ``llm.queries`` holds the registered queries and their SQL.
"""
