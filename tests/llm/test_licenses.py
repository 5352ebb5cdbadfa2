import re

from tillstream.llm import licenses, queries

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """The base columns by looking at every word."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPS)) if w]
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items()
              for key in [phrase.split()] for i in range(len(words)) if words[i:i + len(key)] == key]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})))


TEXTS = [
    "All rights reserved.", "ALL-RIGHTS\nRESERVED all rights reserved", "call rights reserved",
    "all rights reserved" * 3, "cc by cc by cc-by ccby cc  bye", "éall rights reserved",
    "the general public license general public\x00license x", "general public licensee", None, "",
    "Kall rights reserved", "cc cc by by", "all  rights, (reserved) 日本 all rights", "A",
    "Released under the MIT License. All rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "mit the under license released", "license MIT", "The MIT-License x" * 3,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files (the Software)",
    "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met",
]


def scanned(documents, texts):
    rows = licenses.report(documents(*enumerate(texts))).collect()
    return {r.doc_id: r for r in rows}


def test_base_columns_equal_the_definition(documents):
    for i, r in scanned(documents, TEXTS).items():
        assert tuple(r)[1:6] == brute(TEXTS[i]), TEXTS[i]
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_method_finds_notices_and_checks_key_phrases(documents):
    got = {TEXTS[i]: r.labels for i, r in scanned(documents, TEXTS).items()}
    labels = lambda start: next(v for k, v in got.items() if k and k.startswith(start))
    assert labels("Released") == "mit,reserved"
    assert labels("This work") == "gpl,gpl-3.0"
    assert labels("Licensed under CC") == "cc-by,cc-by-nc"
    assert labels("Licensed under the Apache") == "apache-2.0"
    assert labels("mit the under") == "" and labels("license MIT") == ""
    assert labels("Permission") == "mit"
    assert labels("Redistribution") == "bsd"


def test_notice_is_found_anywhere_and_more_than_once(documents):
    notice = "Released under the MIT License."
    texts = ["word " * 500 + notice + " word" * 500, (notice + " license released ") * 300,
             "license " * 3000 + notice]
    assert [r.labels for _, r in sorted(scanned(documents, texts).items())] == ["mit"] * 3


def test_files_with_several_notices_keep_every_label(documents):
    notice = [n for _, n, _ in licenses.TEMPLATES]
    mit, long_mit, apache, bsd, isc = notice[0], notice[1], notice[2], notice[3], notice[9]
    texts = ["\n".join(x) for x in (
        (long_mit, apache, bsd), (mit, apache, bsd), (mit, bsd, isc), notice, notice * 20)]
    texts.append(" filler ".join(notice[::-1]))
    every = sorted({x for x, _, _ in licenses.TEMPLATES} | {"cc-by", "gpl"})
    assert [r.labels.split(",") for _, r in sorted(scanned(documents, texts).items())] == [
        ["apache-2.0", "bsd", "mit"], ["apache-2.0", "bsd", "mit"], ["bsd", "isc", "mit"],
        every, every, every]


def test_rarest_words_are_posted():
    frequencies = {w: 1.0 for w in licenses.licence_words()} | {"mit": 9.0, "released": 8.0, "the": 0.1}
    mit = licenses.index(frequencies)[0]
    assert {"mit", "released"} <= {w for w, _ in mit.postings}
    assert mit.key == ("mit", "license") and mit.key_at == 3


def test_query_on_odd_rows(spark, odd_documents, write):
    rows = queries.op6_licenses(spark, write(documents=odd_documents)).collect()
    expected = sorted(((r.doc_id, *brute(r.text)) for r in odd_documents.collect()), key=str)
    assert sorted((tuple(r)[:6] for r in rows), key=str) == expected


def test_clashing_columns_and_empty_table(clashing):
    assert licenses.report(clashing.limit(0)).count() == 0
    assert licenses.report(clashing).count() == clashing.count()
