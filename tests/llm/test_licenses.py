import re

from pyspark.sql import functions as F

from sheetlens.llm import licenses

SCHEMA = "doc_id long, text string, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = [
    (1, "Released UNDER the MIT-License. Under the mit license!", "x"),
    (2, "Some words. Licensed under the Apache License, Version 2.0. more cc by nc", "x"),
    (3, "This work is licensed under the GNU General Public License, version 3.", None),
    (4, None, None), (5, "", None), (6, "é ü ÀB cc\tby\nnc", None), (6, "é ü ÀB cc\tby\nnc", None),
    (7, "the of and " * 60_000 + "under the mit license", None), (None, "plain text about a license", None),
    (8, "Redistribution and use in source and binary form are not discussed", None),
    (9, "permitted provided Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met", None),
]


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = licenses.scan(docs, licenses.build_index(docs)).collect()
    want = sorted((str(r[0]), *map(str, brute(r[1]))) for r in ROWS)
    assert sorted(tuple(map(str, (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[3].labels == "gpl" and by[3].base_labels == "" and 0.6 <= by[3].score <= 1
    assert by[9].labels == "bsd" and by[8].labels == ""
    assert by[2].labels == "apache-2,cc-by-nc" and by[None].labels == "" and by[4].score == 0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)


def test_counts_cover_all_rows_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    n, df = licenses.document_frequencies(docs, {b"license", b"nowhere"})
    assert n == len(ROWS) and df == {b"license": sum(b"license" in set(licenses.words_of(r[1])) for r in ROWS)}
    none = docs.filter(F.lit(False))
    assert licenses.scan(none, licenses.build_index(none)).count() == 0


def test_a_bundle_keeps_the_notice_of_frequent_words(spark):
    long = {t[0]: t[1] for t in licenses.TEMPLATES if len(t[1]) > 100 or t[0] == "mpl-2"}
    bundle = ". ".join(long[k] for k in ("mit", "apache-2", "bsd", "isc", "mpl-2", "gpl"))
    docs = spark.createDataFrame([(0, bundle, None)] + [(i, long["gpl"] if i % 3 == 0 else f"prose {i}", None) for i in range(1, 60)], SCHEMA)
    got = {r.doc_id: r.labels for r in licenses.scan(docs, licenses.build_index(docs)).collect()}
    assert got[0] == "apache-2,bsd,gpl,isc,mit,mpl-2"
    assert all(got[i] == ("gpl" if i % 3 == 0 else "") for i in range(1, 60))


def test_absent_words_count_in_the_coverage():
    index = licenses.RareTokenIndex.of((("x", "a b c d e f g h i j", ("a b",)),))
    index.idf = dict.fromkeys(index.postings, 1.0)
    find = lambda t: index.find(licenses.words_of(t), set(licenses.words_of(t)))
    assert find("a b") == [] and find("a b c d e") == []
    (label, share, at), = find("z a b c d e f g")
    assert label == "x" and abs(share - 0.7) < 1e-6 and at == 1


def brute_labels(index, text):
    """The method's labels and score, by trying every place of every template."""
    words = licenses.words_of(text)
    labels, best_share = set(), 0.0
    for t, (label, body, phrases) in enumerate(licenses.TEMPLATES):
        own = licenses.words_of(body)
        chosen = sorted(set(own), key=lambda w: (-index.idf.get(w, 0.0), w))[: index.top]
        idf = {q: index.idf.get(w, 0.0) + 1e-9 for q, w in enumerate(own) if w in chosen}
        share = 0.0
        for start in range(-len(own), len(words) + 1):
            exact = any(0 <= start + q < len(words) and words[start + q] == own[q] for q in idf)
            if not exact:
                continue
            there = [q for q in idf if any(0 <= start + q + d < len(words) and words[start + q + d] == own[q] for d in range(-index.slack, index.slack + 1))]
            got = sum(idf[q] for q in there) / sum(idf.values())
            window = words[max(0, start - index.slack) : start + len(own) + 2 * index.slack]
            keys = [licenses.words_of(p) for p in phrases]
            if got >= index.coverage and all(any(window[i : i + len(k)] == k for i in range(len(window))) for k in keys):
                share = max(share, got)
        if share:
            labels.add(label)
            best_share = max(best_share, min(1.0, share))
    return labels, best_share


def test_labels_and_score_equal_every_place_of_every_template(spark):
    import random

    rng = random.Random(6)
    filler = "the of and software license this under work terms copy source public".split()
    rows = []
    for n in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):  # words lost, changed or put between
                i = rng.randrange(len(notice))
                notice[i : i + 1] = rng.choice([[], ["other"], [notice[i], "new"]])
                notice = notice or ["x"]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        rows.append((n, " ".join(words), None))
    docs = spark.createDataFrame(rows, SCHEMA)
    index = licenses.build_index(docs)
    found = 0
    for r in licenses.scan(docs, index).collect():
        text = rows[r.doc_id][1]
        labels, share = brute_labels(index, text)
        base = set(filter(None, brute(text)[4].split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base, text
        if not base:
            assert abs(r.score - share) < 1e-6, text
        found += len(labels)
    assert found > 20
