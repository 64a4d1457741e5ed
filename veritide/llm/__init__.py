"""Operations for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, reads only the columns it names (so extra columns of any
name do no harm) and documents what it does with nulls and empty input.
"""
