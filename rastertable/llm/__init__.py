"""Operations that prepare text, chat and embedding tables for model training.

Nothing outside this subpackage imports it. Every operator is a function from DataFrames to DataFrames;
``queries`` applies each to its whole table.
"""
