from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyweave.llm import line_templates as lt


def plain(rows, tree):
    """Row by row: {(id, text): dropped line numbers}."""
    occ = []
    for i, text in rows:
        if text is None:
            continue
        for no, line in enumerate(text.split("\n")):
            t = line.encode().split()
            if len(t) < tree.min_tokens:
                continue
            t = [lt.VARIABLE if any(48 <= c <= 57 for c in x) else x for x in t]
            occ.append((i, text, no, (len(t), *t[: tree.leading]), tuple(t)))
    seen = defaultdict(set)
    for i, text, _, leaf, t in occ:
        seen[leaf, t].add(text)
    common = Counter()
    for (leaf, t), texts in seen.items():
        for place, token in enumerate(t[tree.leading :]):
            common[leaf, place, token] += len(texts)

    def template(leaf, t):
        g = [
            x if k < tree.leading or x == lt.VARIABLE or common[leaf, k - tree.leading, x] >= tree.min_texts else lt.VARIABLE
            for k, x in enumerate(t)
        ]
        return tuple(g) if sum(x != lt.VARIABLE for x in g) >= tree.constant_share * len(g) else t

    texts, first = defaultdict(set), {}
    for i, text, no, leaf, t in occ:
        p = leaf, template(leaf, t)
        texts[p].add(text)
        from hashlib import md5
        key = (i is None, i or 0, md5(text.encode()).digest(), no)
        first[p] = min(first.get(p, key), key)
    out = defaultdict(set)
    for i, text, no, leaf, t in occ:
        from hashlib import md5
        p = leaf, template(leaf, t)
        key = (i is None, i or 0, md5(text.encode()).digest(), no)
        if len(texts[p]) >= tree.min_texts and not (tree.keep_first and key == first[p]):
            out[i, text].add(no)
    return out


def check(df, tree):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = plain(rows, tree)
    got = lt.drop_recurring(df.withColumn("was", F.col("text")), tree=tree).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want.get((r.doc_id, r.was), set())
        assert set(r.dropped_lines) == gone
        if r.was is None:
            assert r.text is None
        else:
            assert r.text == "\n".join(x for k, x in enumerate(r.was.split("\n")) if k not in gone)
    return {r.doc_id: r for r in got}


def planted(spark):
    rows = []
    for i in range(12):
        variable = f"Copyright notice by user{i} of this site all rights are reserved for ever and a day"
        almost = f"This long passage stands in many texts with the word {'abcdefghijkl'[i]}x changed in the middle of it all"
        rows.append((i, f"unique start {'xyz'[i % 3] * (i + 1)} of text\n{variable}\n{almost}\nshort\nown line number and words {'q' * (i + 1)} here"))
    rows += [(100 + k, "copied text with a line\nthat only copies share today") for k in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_plain(spark, documents, odd):
    check(documents, lt.Tree(min_texts=3))
    check(odd, lt.Tree(min_texts=2))
    for first in (True, False):
        got = check(planted(spark), lt.Tree(min_texts=5, keep_first=first))
        assert set(got[3].dropped_lines) == {1, 2, 4}
        assert set(got[0].dropped_lines) == (set() if first else {1, 2, 4})
        # Copies of one text do not make its lines recur.
        assert got[105].dropped_lines == []


def test_false_alarms_of_the_bitmap_change_nothing(spark):
    check(planted(spark), lt.Tree(min_texts=5, bits=15))


def test_edges(odd, none):
    assert lt.drop_recurring(none).count() == 0
    clash = odd.withColumn("dropped_lines", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("no", F.lit(0))
    out = lt.drop_recurring(clash)
    assert out.count() == odd.count() and dict(out.dtypes)["dropped_lines"] == "array<int>"


def test_the_limit_depends_on_the_length(spark):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    passage = " ".join(word(1000 + k) for k in range(60))
    rows = []
    for i in range(400):
        lines = [f"start {word(i)} own words {word(7 * i)}"]
        lines += [passage] * (i < 3) + ["Read more", "}", "Page 1"] * (i % 3 == 0) + ["middle sized line of some words"] * (i < 9) + ["Two words"] * (i < 50)
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lt.drop_recurring(df.withColumn("was", F.col("text"))).collect()}
    for i, r in got.items():
        gone = [x for k, x in enumerate(r.was.split("\n")) if k in set(r.dropped_lines)]
        assert gone == [passage] * (0 < i < 3) + ["Read more"] * (i % 3 == 0 and i > 0), i
