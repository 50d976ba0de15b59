"""Shared by the tests of this folder."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)
