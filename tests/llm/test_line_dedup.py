from tillstream.llm import line_dedup as L


def clean(table, **how):
    return {(r.doc_id, r.source, r.text) for r in L.drop_boilerplate(table, **how).collect()}


def test_lines_above_the_ratio_go_per_host(documents):
    rows = [(i, f"own {i}\nshared\n common ", None, "a") for i in range(4)]
    rows += [(10 + i, f"other {i}\nshared", None, "b") for i in range(2)]
    got = clean(documents(*rows), max_ratio=0.5, min_pages=3)
    assert {t for _, s, t in got if s == "a"} == {f"own {i}" for i in range(4)}
    assert {t for _, s, t in got if s == "b"} == {f"other {i}\nshared" for i in range(2)}


def test_the_ratio_itself_is_kept(documents):
    rows = [(i, "half" if i < 3 else f"own {i}", None, "a") for i in range(6)]
    # Three copies of one page are one page.
    assert {t for _, _, t in clean(documents(*rows), max_ratio=0.25)} >= {"half"}
    rows = [(i, f"half\n{i}" if i < 3 else f"own {i}", None, "a") for i in range(6)]
    assert ("half" in {t.split("\n")[0] for _, _, t in clean(documents(*rows), max_ratio=0.5)})
    assert ("half" not in {t.split("\n")[0] for _, _, t in clean(documents(*rows), max_ratio=0.49)})


def test_null_hosts_are_one_site_and_blank_lines_stay(documents):
    rows = [(i, f"\n\nshared\n \n{i}", None, None) for i in range(5)]
    assert {t for _, _, t in clean(documents(*rows))} == {f"\n\n \n{i}" for i in range(5)}


def test_odd_rows_and_clashing_columns(clashing):
    got = L.drop_boilerplate(clashing, dropped="n_dropped")
    assert got.columns == [*clashing.columns, "n_dropped"]
    before = sorted((str(r.doc_id), str(r.text)) for r in clashing.collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == before
    assert {r.n_dropped for r in got.collect()} == {0}
    assert L.drop_boilerplate(clashing.limit(0)).count() == 0


def test_a_host_with_all_rows_and_many_copies(documents):
    rows = [(i, "copy\nof\na page", None, "a") for i in range(300)]
    rows += [(1000 + i, f"menu\ntext {i}", None, "a") for i in range(30)]
    got = clean(documents(*rows), max_ratio=0.2)
    assert ("copy\nof\na page" in {t for _, _, t in got})
    assert {t for d, _, t in got if d >= 1000} == {f"text {i}" for i in range(30)}
