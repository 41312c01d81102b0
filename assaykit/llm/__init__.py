"""Operations for language-model training data, one module per operation.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
