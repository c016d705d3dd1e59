"""Plain versions of what the operators share."""

import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[\x20\t\n\v\f\r]+", (text or "").translate(_LOWER)) if w]
