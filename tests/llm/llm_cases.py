"""Rows that every operator must stand."""

import os

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

LONG = " ".join(f"wort{i % 977} de la {i % 31}" for i in range(20_000))
PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up five dozen jars of liquid sulphur "
         "and nobody in the old harbour town could say why the lanterns had burned blue since early spring")

#: doc_id, text: nulls, empty and very long texts, ties and repeated rows.
EDGES = [
    (1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, LONG), (6, "   \n\t "), (7, "!!! 12 ..."), (8, "one two"),
    (None, PROSE + " at last"), (None, None), (9, "Ünïcode ñ 漢字 K 𝔘 text"), (10, PROSE + " at last"), (10, "another text with id ten"),
]
