"""Operators for preparing language-model training data.

Operators over a table of documents or vectors, one module each. Every operator takes
a DataFrame and column names, keeps its work in Spark stages and returns a
DataFrame; ``queries.py`` registers one query per operator over the driver's
``documents`` table. Nothing else in the library imports this subpackage.

What holds for all of them, unless a docstring says otherwise: a null text is
an empty one, and an empty one is processed like any other; a null id stays
null; repeated rows each get their rows; an empty table gives an empty result;
of other columns, operators that return documents pass them on unchanged under
their own names, and the rest ignore them, whatever they are called.
"""
