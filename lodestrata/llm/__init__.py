"""Operations for large training-data pipelines, one module per operator.

Nothing else in the package imports this subpackage; the query registry picks
it up only when it is there.
"""
