"""Tokens of query strings on the driver, equal to the column expressions of ``tokenize``."""

from __future__ import annotations

import re

from repolens.functions.tokenize import MAX_LENGTH, MIN_LENGTH, STOP_WORDS

_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def tokenize(text: str) -> list[str]:
    return [t for t in (p.lower() for p in _SPLIT.split(text or "")) if MIN_LENGTH <= len(t) <= MAX_LENGTH and t not in STOP_WORDS]


def word_tokens(text: str) -> list[str]:
    return [t.lower() for t in re.findall(r"\w+", text or "")]
