from __future__ import annotations

import random
import re

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tallyweave.llm import licenses


def test_families(spark, documents):
    cases = {
        1: ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["apache"]),
        2: ("Released under the MIT License.", ["mit"]),
        3: ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
        4: ("Licensed under CC BY-NC 4.0.", ["cc"]),
        # A wrapped license: every line is a piece of it.
        5: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", ["bsd"]),
        6: ("He drove without a license and was granted permission to leave free of charge.", []),
        7: ("Thnder of the ondly inner and this that", []), 8: ("", []), 9: (None, []),
        10: ("Released under the MIT License.\nLicensed under CC BY 4.0.", ["cc", "mit"]),
    }
    model = licenses.fit(documents)
    assert 0.6 <= model.threshold < 1 and "license" in model.anchors and "the" not in model.anchors
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df, model).collect()}
    for k, (_, want) in cases.items():
        assert sorted({x.family for x in got[k] if x.confirmed}) == want, (k, got[k])
    assert got[1][0].no == 1
    # What the classifier finds in the documents is what their lines say.
    rows = licenses.scan(documents, model).collect()
    assert len(rows) == documents.count()
    for r in rows:
        said = {n: x for n, x in enumerate((r.text or "").split("\n")) if "icense" in x}
        assert {x.no for x in r.licenses if x.confirmed} == set(said)


def test_edges(odd, none):
    model = licenses.fit(none)
    assert licenses.scan(none, model).count() == 0
    clash = odd.withColumn("licenses", F.lit(1)).withColumn("w", F.lit(2)).withColumn("family", F.lit("x"))
    out = licenses.scan(clash, licenses.fit(odd))
    assert out.count() == odd.count() and out.filter(F.size("licenses") > 0).count() == 0


def test_many_notices_do_not_hide_each_other(spark):
    notices = ["Licensed under the Apache License, Version 2.0.", "Apache licensed, see the version above."]
    rng = random.Random(4)
    prose = ["river", "stone", "window", "garden", "evening", "letter", "road", "the", "of", "a", "and", "with"]
    rows = []
    for k in range(1500):
        lines = [" ".join(rng.choices(prose, k=9)) for _ in range(2)]
        # A third of the documents, the hot source, carry a notice; some in words of their own.
        rows.append((k, "\n".join(lines + [notices[k % 30 == 0]]) if k % 3 == 0 else "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(df)
    assert {"apache", "license", "licensed", "mit", "gnu"} <= set(model.anchors)
    got = {r.doc_id: r.licenses for r in licenses.scan(df, model).collect()}
    exact = [k for k in got if k % 3 == 0 and k % 30]
    assert all([x.family for x in got[k] if x.confirmed] == ["apache"] for k in exact)
    assert not any(got[k] for k in got if k % 3)


def plain_scan(model, text, places):
    """The paragraphs of one text, classified and confirmed by the letter of the definition."""
    s, out = model.settings, []
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    grams = lambda w: set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
    weights, bias = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    for no, line in enumerate((text or "").split("\n")):
        w = words(line)
        if not set(w) & set(model.anchors):
            continue
        for g in grams(w) - places.keys():
            places[g] = HashingTF(numFeatures=s.features).indexOf(g)
        x = np.zeros(s.features)
        x[[places[g] for g in grams(w)]] = 1
        z = np.exp(weights @ x + bias - (weights @ x + bias).max())
        p = z / z.sum()
        best = 1 + int(p[1:].argmax())
        if p[best] >= model.threshold:
            family, own = model.families[best], grams(w)
            shares = [(len(own & grams(words(t))), grams(words(t))) for f, t in model.templates if f == family]
            sure = any(n >= s.confirm * len(t) or (len(own) >= 2 * s.window - 1 and n >= s.confirm * len(own)) for n, t in shares)
            out.append((no, family, round(float(p[best]), 5), sure))
    return out


def test_scan_against_plain(spark, documents):
    model = licenses.fit(documents)
    long = " ".join(["filler"] * 200_000)
    whole = [(-10 - k, f"He said so.\n{t}\n{t[: len(t) // 2]}") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    extra = spark.createDataFrame(
        whole + [(-1, f"{long}\nReleased under the MIT License."), (-2, f"{long} Released under the MIT License."), (-3, "Licensed under\nCC BY 4.0.\n\nmit license gnu")],
        "doc_id long, text string",
    )
    places, n = {}, 0
    for r in licenses.scan(documents.select("doc_id", "text").unionByName(extra), model).collect():
        got = [(x.no, x.family, round(x.probability, 5), x.confirmed) for x in r.licenses]
        want = plain_scan(model, r.text, places)
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want], r.doc_id
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-5)
        n += len(want)
    assert n > len(whole)


def test_helper_names_leave_columns_alone(odd):
    clash = odd.withColumns({c: F.lit(c) for c in ("__license_rk", "__found", "t", "no")})
    out = licenses.scan(clash, licenses.fit(odd))
    assert out.columns == clash.columns + ["licenses"] and out.filter("`__found` = '__found' AND t = 't'").count() == odd.count()


def plain_alike(model, line_words):
    grams = lambda w: set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
    s, own = model.settings, grams(line_words)
    for _, t in model.templates:
        whole = grams(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
        n = len(own & whole)
        if n >= s.confirm * len(whole) or (len(own) >= 2 * s.window - 1 and n >= s.confirm * len(own)):
            return True
    return False


def test_counts_and_threshold_come_from_every_paragraph(spark):
    rng = random.Random(9)
    prose = ["river", "stone", "window", "garden", "evening", "letter", "road", "the", "of", "a", "and", "with"]
    usual = ["hereby", "conditions", "the software is provided"]
    rows = []
    for k in range(40):
        lines = [" ".join(rng.choices(prose, k=9)) for _ in range(30)]
        # Usual words late in long documents, and lines near templates beside them.
        lines += [f"{rng.choice(usual)} {' '.join(rng.choices(prose, k=5))}" for _ in range(10)] if k < 4 else []
        lines += ["he has a license to sell the garden"] * (k % 5 == 0) + [licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1]]
        lines += ["copies or substantial portions of the Software and the river", "", "?"]
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(df)
    s, vocabulary = model.settings, {w for _, t in model.templates for w in re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())}
    cut = [(k, re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", line.lower())) for k, text in rows for line in text.split("\n")]
    unknown = [(k, w) for k, w in cut if w and not plain_alike(model, w)]
    assert len(unknown) < sum(bool(w) for _, w in cut) - 40
    held = {w: sum(w in words for _, words in unknown) for w in vocabulary}
    limit = max(2, s.anchor_share * len(unknown))
    always = {w for w in vocabulary if "licens" in w or w in model.families or w in licenses.NAMES}
    want = {w for w in vocabulary if w in always or (held[w] <= limit and len(w) > 1 and not w.isdigit())}
    # Counted over one line of each document, words usual here were anchors ("software" and "to" among them).
    assert set(model.anchors) == want and not {"hereby", "conditions"} & want and "license" in want
    # The threshold is the quantile over all held-out unknown paragraphs, those without an anchor at 0.
    third = {r.doc_id for r in df.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) == 0).collect()}
    text = [" ".join(w) for k, w in unknown if k in third]
    places, ps = {}, []
    loose = licenses.Model(model.classifier, model.families, model.anchors, 0.0, s, model.templates)
    for t in text:
        ps += [x[2] for x in plain_scan(loose, t, places)] or [0.0]
    assert len(ps) == len(text) and abs(model.threshold - max(s.least_probability, np.quantile(ps, s.quantile))) < 2e-5
