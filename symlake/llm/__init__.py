"""Operations of a training-data pipeline: ten operators over documents, pages and vectors.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
