"""Query language: lexer, parser and compiler to DataFrames."""
