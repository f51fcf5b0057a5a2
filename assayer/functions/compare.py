"""The five comparison operators and their spellings."""

from __future__ import annotations

import operator

from assayer.errors import IncorrectOperator

# Accepted spellings, and names in reports.
SPELLINGS = {
    "greater than": "gt", "gt": "gt", ">": "gt",
    "greater than or equal": "gte", "gte": "gte", ">=": "gte",
    "equal": "eq", "=": "eq",
    "lesser than or equal": "lte", "lte": "lte", "<=": "lte",
    "lesser than": "lt", "lt": "lt", "<": "lt",
}
TITLES = {"gt": "GreaterThan", "gte": "GreaterThanEqual", "eq": "Equal", "lte": "LesserThanEqual", "lt": "LesserThan"}
FUNCTIONS = {"gt": operator.gt, "gte": operator.ge, "eq": operator.eq, "lte": operator.le, "lt": operator.lt}


def parse_operator(text: str) -> str:
    if text not in SPELLINGS:
        raise IncorrectOperator(text)
    return SPELLINGS[text]
