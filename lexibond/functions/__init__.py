"""Column functions; every one is a composition of built-in expressions."""

from lexibond.functions.scores import llr, llr_defined
from lexibond.functions.text import clean_token, decade, lang_from_path, split_pair

__all__ = ["clean_token", "decade", "lang_from_path", "llr", "llr_defined", "split_pair"]
