from __future__ import annotations

import textwrap
from pathlib import Path

from brute import ODD
from pyspark.sql import functions as F

from barloom.llm import licences


def test_equal_up_to_layout_and_spelling(spark):
    mit = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text"))
    variant = "The\n".join(mit.replace("License", "LICENCE").replace(" ", "  \n ", 3).upper().split("THE\n")) + "\n"
    docs = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + variant), (3, mit + " extra"), (4, "text\n  released under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0"), (5, mit), (5, mit)]
    docs += [(10 + i, t) for i, t in enumerate(ODD)] + [(None, "Licensed under the Apache License, Version 2.0")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id BIGINT, text STRING, digest STRING, kind STRING")
    rows = licences.scan(frame, licences.known_table(spark)).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in rows}
    assert got[1] == got[2] == got[5] == ("MIT", "") and got[3] == (None, "")
    assert got[4] == (None, "CC-BY-NC-4.0,MIT") and got[None] == (None, "Apache-2.0")
    assert all(got[10 + i] == (None, "") for i in range(len(ODD)))
    assert licences.scan(frame.limit(0), licences.known_table(spark)).count() == 0
    assert licences.scan(frame, licences.known_table(spark).limit(0)).filter("licence IS NOT NULL").count() == 0


def test_equivalent_words(spark):
    """Other spellings of a licence's words, also where a line breaks inside a phrase, and words that only look like them."""
    pairs = [("noninfringement", "NON-INFRINGEMENT"), ("non-commercial", "noncommercial"), ("sublicense", "sub-licence"), ("copyright owner", "copyright\nholder"),
             ("organization", "organisation"), ("authorized", "authorised"), ("labor", "labour"), ("center", "centre"), ("fulfillment", "fulfilment"),
             ("judgment", "judgement"), ("acknowledgment", "acknowledgement"), ("while", "whilst"), ("willful", "wilful"), ("percent", "per\ncent"),
             ("catalog", "catalogue"), ("modeling", "modelling"), ("program", "programme"), ("practice", "practise"), ("version 2", "Version 2.0"), ("analyze", "analyse")]
    others = [("emphasis", "emphasize"), ("license", "licensed"), ("programmer", "program"), ("version 2.1", "version 2"), ("central", "center")]
    body = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text"))
    frame = spark.createDataFrame([(f"to {a} it", f"To {b} it.") for a, b in pairs + others], "a STRING, b STRING")
    form = lambda c: licences.digest(F.array_join(licences.canonical_lines(F.col(c)), " "))
    assert [r[0] for r in frame.select(form("a") == form("b")).collect()] == [True] * len(pairs) + [False] * len(others)
    docs = spark.createDataFrame([(1, body.replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT").replace("COPYRIGHT HOLDERS", "COPYRIGHT\nOWNERS"))], "doc_id BIGINT, text STRING")
    assert [r["licence"] for r in licences.scan(docs, licences.known_table(spark)).collect()] == ["MIT"]


def test_wrapped_clauses_are_no_copyright_lines(spark):
    """Known texts wrapped at many widths, one of which starts a line with each of their words."""
    whole = [(n, t) for n, k, t in licences.KNOWN if k == "text"]
    head = "Copyright (c) 2020, 2021 Someone\n(c) 2019 Else\nCopyright The Authors\n\n"
    docs = [(n, head + textwrap.fill(t, w)) for n, t in whole for w in range(20, 121)]
    frame = spark.createDataFrame([(f"{n}/{i}", t) for i, (n, t) in enumerate(docs)], "doc_id STRING, text STRING")
    rows = licences.scan(frame, licences.known_table(spark)).collect()
    assert len(rows) == len(docs) and [r["doc_id"] for r in rows if r["licence"] != r["doc_id"].split("/")[0]] == []


def test_copyright_lines(spark):
    dropped = ["Copyright (c) 2020 X", " * Copyright 1999-2003 X", "(C) 2020 X", "© X", "(c) Copyright X", "Copyright [yyyy] [name]", "Copyright <YEAR> X",
               "Copyright Joyent, Inc. and other Node contributors.", "Copyright The Authors", "Copyright: X", "(c) X Ltd., 2004", "COPYRIGHT (C) X"]
    kept = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE FOR ANY", "(c) You must retain, in the Source form", "copyright",
            "copyright, patent and trademark notices", "copyright-like laws", "copyright the software, and", "(c) under Patent Claims", "copyright law: that is"]
    frame = spark.createDataFrame([(x,) for x in dropped + kept], "x STRING")
    got = {r["x"] for r in frame.filter(F.size(licences.canonical_lines(F.col("x"))) > 0).collect()}
    assert got == set(kept)


def test_whole_copies_of_common_licences(spark):
    body = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text")).split("\n", 1)[1]
    bsd = next(t for n, k, t in licences.wordings() if n == "BSD-2-Clause" and k == "text")
    docs = [("MIT", body), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 X\n\n" + body), ("BSD-2-Clause", "Copyright 2019, X\nAll rights reserved.\n" + bsd)]
    docs += [(n, t) for n, k, t in licences.wordings() if k == "text"]
    names = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0-Perl"}
    files = [p for p in Path("/usr/share/common-licenses").glob("*") if p.is_file() and not p.is_symlink()]
    docs += [(names.get(p.name, p.name), p.read_text("utf-8")) for p in files]
    docs += [(None, "MIT"), (None, body + " more"), (None, body[:-20])]
    frame = spark.createDataFrame([(f"{n}/{i}", t) for i, (n, t) in enumerate(docs)], "doc_id STRING, text STRING")
    rows = licences.scan(frame, licences.known_table(spark)).collect()
    assert len(rows) == len(docs) and [r["doc_id"] for r in rows if str(r["licence"]) != r["doc_id"].split("/")[0]] == []
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"} <= {n for n, _ in docs}


def test_plain_parts_spare_no_match(spark):
    """Every match of a spelling holds one of its plain parts, so replacements are the same with and without the search for them."""
    text = (
        "http://a https://b licence sublicence analogue catalogues analyse analysing authorise capitalised organisation realises utilisations "
        "calibre centres cancelled modelling signalled favourite labour acknowledgement judgement fulfil fulfils fulfilment artefacts offences "
        "practised programme programmes whilst wilful wilfull willful willfull copyright holders non commercial non infringing sub licence "
        "sub licensed per cent version 2 0 realise optimising emphasise recogniser"
    )
    words = text.split(" ")
    samples = [text, *words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:]))]
    frame = spark.createDataFrame([(s,) for s in samples], "x STRING")
    for spellings in (licences.SPELLINGS, licences.PHRASES):
        plain = F.col("x")
        for pattern, kept_form, _ in spellings:
            plain = F.regexp_replace(plain, pattern, kept_form)
        rows = frame.select("x", plain.alias("want"), licences._replaced(F.array("x"), spellings)[0].alias("got")).collect()
        assert len(rows) == len(samples) and all(r["want"] == r["got"] for r in rows)
        assert sum(r["want"] != r["x"] for r in rows) > 10


def test_repeated_rows_stay(spark):
    """Equal rows, also with a null id, come back as often as they were given."""
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 5 + [(None, "x")] * 3 + [(2, None)], "doc_id BIGINT, text STRING")
    rows = licences.scan(docs.repartition(3), licences.known_table(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["notices"]) for r in rows) == [(0, "")] * 3 + [(1, "MIT")] * 5 + [(2, "")]
