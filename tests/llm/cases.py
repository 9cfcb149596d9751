"""Rows that the operators' tests share."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{k} word{k * k}" for k in range(40))

#: Nulls everywhere, empty and tiny texts, ties, repeated rows and ids, odd white space, characters of all lengths, one long text.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", None, 3), (4, "one two three four", "en", "a", None), (5, "one two three four", "en", "b", 18), (6, "ONE two Three four five six", "en", "b", 27),
    (6, "ONE two Three four five six", "en", "b", 27), (7, "one two three four five six seven eight nine ten", None, "a", 48), (7, "other text with the same id and so on", "en", "a", 37), (None, "no id at all here for this one", "en", "a", 30),
    (8, " \t\n\x0b\x0c\r ", "de", "a", 7), (9, "über größe façade naïve 日本語 текст ελληνικά 🎉 é́", "de", "c", 40), (10, "a b c d <|endoftext|> x's I'm don't 12345 #$% &&& |", "fr", "c", 50), (11, "line\nline\nline\n\nother\nline", "fr", "c", 20),
    (12, "same same same " * 60, "es", "d", 900), (13, PASSAGE + " tail one", "es", "d", 100), (14, "head two " + PASSAGE, "es", "d", 100), (15, "x " * 30_000 + PASSAGE, "en", "a", 60_000), (16, "\x00 nul \x7f", "en", "", 7), (17, PASSAGE.upper(), "es", "d", 100),
]
