"""SQL text: tokens, expressions, statements and routines of the two dialects, for Spark and for each other."""

from .expressions import translate_expression, translate_query
from .routines import translate_routine
from .tokens import split_statements, tokenize

__all__ = ["split_statements", "tokenize", "translate_expression", "translate_query", "translate_routine"]
