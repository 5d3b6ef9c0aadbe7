import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsmith.llm import html_extract, license_scan, packing, pii, piece_codec, quality, toxicity

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# --- personal data ------------------------------------------------------------------------------


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) * (2 if i % 2 else 1) - (9 if i % 2 and int(c) > 4 else 0) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(1)
    for alphabet in ("a.@-+ 1203 ().4é", "0123456789.  -+", "ab@@..1 "):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(50)))
            assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("x 4111 1111 1111 1111, +1 (499) 555-6503, 8.8.8.8, a.b@c.de") == brute_spans("x 4111 1111 1111 1111, +1 (499) 555-6503, 8.8.8.8, a.b@c.de") != []


def test_parts_of_very_many_digits():
    zeros = "0" * 6000
    assert [k for _, k, _ in pii.base_spans(f"{zeros}1.2.3.{zeros} 1.2.3.{'9' * 6000}")] == [1]


def test_pii_query(spark):
    docs = documents(spark)
    for f in pii.query(spark, SF).collect():
        want = brute_spans(docs[f["doc_id"]])
        assert f["base_sha256"] == hashlib.sha256(pii.spans_text(want).encode()).hexdigest()
        assert [f[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(k == i for _, k, _ in want) for i in range(4)]


def test_patterns_find_the_unseen(spark):
    """Cards in a context teach it; a member number in the same context is found, a number elsewhere is not."""
    rows = [(i, f"Please charge account {4111111111111111} today.") for i in range(1)]
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "378282246310005"]
    rows = [(i, f"Order: charge account {c} today.") for i, c in enumerate(cards)]
    rows += [(10, "Order: charge account MX-99-1234567 today."), (11, "The year 2020-11-12345 was long.")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[10]["n_found"] == 1 and found[10]["spans"] == "id:22:35" and found[11]["n_found"] == 0
    assert "[ID]" in [r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 10").collect()][0]


def test_secrets_and_what_they_teach(spark):
    """Values of keys that name secrets are found; a key that shares secrets with them is learnt, and finds unseen ones of that shape."""
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(39)) + "7" for _ in range(12)]
    rows = [(i, f'intro {i} token = "{h}"### end') for i, h in enumerate(hexes[:6])]
    rows += [(20 + i, f"begin {i} session: {h} more") for i, h in enumerate(hexes[:6])]
    rows += [(40, f"other text session: {hexes[8]} and"), (41, f"a commit of {hexes[9]} here"), (42, "session: 2020-11-12345-9 here"), (43, f"api_key='{hexes[10][:20]}'"), (44, "the key: 12345678 is short")]
    found = {x["doc_id"]: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = lambda i: [f"id:{t.index(h)}:{t.index(h) + len(h)}" for t in [dict(rows)[i]] for h in [*hexes, hexes[10][:20]] if h in t][:1]
    for i in [*range(6), *range(20, 26), 40, 43]:
        assert found[i]["spans"] == at(i)[0]
    assert [found[i]["spans"] for i in (41, 42, 44)] == ["", "", ""]


def test_patterns_have_whole_words():
    """A neighbour counts whole, however long, and where a word is missing or has no letter there is no pattern."""
    spans = lambda t, v: pii.Around(t).patterns(t.index(v), t.index(v) + len(v))[0]
    a, b = "x" * 300, "y" + "x" * 299
    assert spans(f"call {a} 12345678", "12345678") != spans(f"call {b} 12345678", "12345678")
    assert len(spans(f"call {a} 12345678 {a}", "12345678")) == 2
    assert spans("12345678", "12345678") == [] == spans("| 11 | 12345678 | 13 |", "12345678")
    assert len(spans("call 12345678", "12345678")) == 0


def test_unseen_identifiers_in_known_contexts(spark):
    """Precision and recall on planted identifiers that no seed pattern matches, among as many numbers in other places."""
    r = random.Random(5)
    number = lambda: f"{r.choice('ABC')}{r.randrange(10**7, 10**8)}"
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    rows, planted = [], set()
    for i in range(400):
        text = " ".join(word() for _ in range(20))
        if i % 4 == 0:
            text += f" reach the owner at {word()}{i}@mail.org for help"
        elif i % 4 == 1:
            text += f" reach the owner at {number()} for help"
            planted.add(i)
        elif i % 4 == 2:
            text += f" {word()} part {number()} {word()}"
        rows.append((i, text))
    found = {x["doc_id"] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("n_found > 0").collect()}
    assert found == planted


# --- packing ------------------------------------------------------------------------------------


def test_words_make_the_texts_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    coder, whole = packing.encoder(path), Tokenizer.from_file(path)
    r = random.Random(2)
    signs = list("abcDEé ÉñßİıΣς²½ⅷ_'.,!<|>🙂日́  \x1c\x85\n\t '") + ["'s", "<|endoftext|>", "it's"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)] + ["", "x" * 3000]
    for t, ids in zip(texts, coder.encode([t.encode() for t in texts], 2), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_each_token_comes_of_its_own_merge():
    """What makes merging by ranks the same as following the list of merges."""
    import json

    model = json.load(open(packing.default_tokenizer()))["model"]
    rank = {tuple(m): i for i, m in enumerate(model["merges"])}
    for i, (a, b) in enumerate(model["merges"]):
        token = a + b
        assert model["vocab"][token] == 512 + i
        ended = token.endswith("</w>")
        parts = list(token.removesuffix("</w>"))
        parts[-1] += "</w>" * ended
        while len(parts) > 1:
            _, at = min((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [token]


def test_hilbert():
    import itertools

    for n, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(2**bits), repeat=n)))
        keys = packing.hilbert_keys((points + 0.5) / 2**bits * 2 - 1, bits)
        assert sorted(keys) == list(range(len(points)))
        assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_pack(spark):
    from tokenizers import Tokenizer

    whole, docs = Tokenizer.from_file(packing.default_tokenizer()), documents(spark)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs.items()}
    pieces = packing.query(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    for i, ps in by_doc.items():
        assert [p["start"] for p in sorted(ps, key=lambda p: p["start"])] == np.cumsum([0] + [p["length"] for p in sorted(ps, key=lambda p: p["start"])])[:-1].tolist()
        assert sum(p["length"] for p in ps) == len(ids[i])
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps])[:-1].tolist()
        n = sum(p["length"] for p in ps)
        assert n == 4096 or n < 4096 and n & (n - 1) == 0  # nothing is padded
    assert set(by_doc) == set(docs) and sorted(by_sequence) == list(range(len(by_sequence)))


# --- licences -----------------------------------------------------------------------------------


def test_license_base(spark):
    docs = documents(spark)
    for f in license_scan.query(spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[f["doc_id"]]))
        at, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at, labels = at + found, labels | {label} if found else labels
        assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], f["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, f["labels"].split(","))) and 0 <= f["score"] <= 1


def test_license_method(spark):
    text = {
        0: "This work is licensed under the GNU General Public License, version 3.",
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
        2: "Redistribution and use in source and binary forms, with or without modification, are permitted",
        3: "The general public may have a license to be gnu version 3",
        4: "a modification of the software is permitted; charge any person",
    }
    rows = list(text.items()) + [(10 + i, "the and of a in to is other words here") for i in range(200)]
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(5)] == ["gpl-3", "mit", "bsd", "", ""] and not any(found[i] for i in found if i >= 10)


def test_several_licenses_in_one_text(spark):
    """Each template in one long text is found as it is alone, whatever stands before it."""
    names = [label for label, _, _ in license_scan.TEMPLATES]
    texts = [b" ".join(words).decode() for _, words, _ in license_scan.TEMPLATES]
    filler = " the and of a in to is other words here" * 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, filler.join(texts)), (101, filler.join(reversed(texts))), (102, texts[0] + filler + texts[names.index("gpl-3")])]
    rows += [(200 + i, filler + " gnu general public license of version") for i in range(50)]
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x for i, x in enumerate(names) if x not in found[i]] == []
    assert found[100] == found[101] == set(names) and found[102] == {"mit", "gpl-3"} and found[200] == {""}


def test_licenses_as_files_have_them(spark):
    """Notices with the names, marks and comment signs that real files put between the words."""
    texts = {
        "gpl-2": "/* foo.c\n * This file is part of foo.\n *\n * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n */",
        "gpl-3": "# Foo is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        "isc": "Copyright (c) 2004 Some Body <some@body.org>\n\nPermission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "cc-by": "Except where otherwise noted, this work is licensed under a Creative Commons Attribution 4.0 International License. See it.",
        "mpl-2": "<!-- This Source Code Form is subject to the terms of the Mozilla Public\n   - License, v. 2.0. If a copy of the MPL was not distributed with this\n   - file, You can obtain one at http://mozilla.org/MPL/2.0/. -->",
        "apache-2": "// You may obtain a copy of the License. Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License.",
        "bsd,bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions.\n3. Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "mit": "// SPDX-License-Identifier: MIT\nint main;",
        "": "It is free and the general public may use the software under no license at all; version 2 of the text says so.",
    }
    rows = list(enumerate(texts.values())) + [(100 + i, "the and of a in to is other words here") for i in range(100)]
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts)


def brute_labels(index, text):
    """Every template at every place, without an index."""
    words, out = license_scan.words_of(text), {}
    drift = license_scan.DRIFT
    for t, (label, template, phrases) in enumerate(index.templates):
        rare = set(index.postings[t])
        at = lambda i: words[i] if 0 <= i < len(words) else None
        spots = [p for p, w in enumerate(template) if w in rare]
        for begin in range(-len(template), len(words)):
            if not any(at(begin + p) == template[p] for p in spots):
                continue
            agreed = sum(index.weight(template[p]) for p in spots if any(at(begin + p + d) == template[p] for d in range(-drift, drift + 1)))
            here = words[max(0, begin - drift) : max(0, begin + len(template) + drift)]
            most = sum(index.weight(template[p]) for p in spots if template[p] in here)
            score = min(1.0, agreed / max(most, 1e-9)) * min(1.0, 0.5 + most / index.weights[t])
            if score >= license_scan.ENOUGH and all(any(here[i : i + len(p)] == p for i in range(len(here))) for p in phrases):
                out[label] = max(score, out.get(label, 0.0))
    return out


def test_licenses_against_brute_force():
    r = random.Random(12)
    index = license_scan.Index(1000, {"the": 900, "of": 800, "license": 90, "version": 70, "software": 60, "gnu": 9, "general": 40, "public": 45})
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 4)):
            _, template, _ = r.choice(license_scan.TEMPLATES)
            part = [w for w in template if r.random() > 0.06]
            for _ in range(r.randrange(3)):
                part.insert(r.randrange(len(part) + 1), r.choice([b"foo", b"license", b"version"]))
            words += part[r.choice([0, 0, 3]) :] + [b"x"] * r.randrange(6)
        text = b" ".join(words)
        got, want = index.scan(text)[3], brute_labels(index, text)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


# --- toxicity -----------------------------------------------------------------------------------


def brute_kernel(a, b):
    from itertools import combinations

    def features(w):
        w, out = "^" + w + "$", Counter()
        for i in range(len(w)):
            for j, k in combinations(range(i + 1, min(len(w), i + toxicity.SPAN)), 2):
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    norm = lambda z: sum(v * v for v in z.values()) ** 0.5
    return (sum(v * y[f] for f, v in x.items()) / norm(x) / norm(y)) ** toxicity.POWER


def test_kernel():
    marks, words = ["idiot", "banana", "the", "aaaaaa"], ["idiot", "idxiot", "b", "ananas", "aaa", "x" * 3000, "bannana", ""][:-1]
    assert np.allclose(toxicity.Kernel(marks)(words), [[brute_kernel(w, m) for m in marks] for w in words], atol=1e-5)


def test_toxicity_on_held_out_rows(spark):
    """Trained without them, the machine tells most toxic held-out rows from the others."""
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in toxicity.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in found)
    y, p = np.array([toxic[r["doc_id"]] for r in found]), np.array([r["predicted"] for r in found])
    assert p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.01


def test_gaps_and_insertions():
    insults = ["idiot", "moron", "clown"]
    r = random.Random(3)
    clean = lambda: " ".join("".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 8))) for _ in range(12)) + "."
    texts, y = [], []
    for i in range(400):
        t = clean()
        texts.append((t[:-1] + " " + r.choice(insults) + "." if i % 4 == 0 else t).encode())
        y.append(i % 4 == 0)
    model = toxicity.train(texts, np.array(y))
    plain, spelled, cut, other = model.scores([b"you are an idiot here.", b"you are an i d i o t here.", b"you are an i.d-i*o.t here.", b"you are an idol here."])
    assert min(plain, spelled, cut) > 0.7 > 0.3 > other
    inserted, far = (model.decisions([x])[0] for x in (b"idioot", b"table"))
    assert inserted > far


def test_windows_of_long_sentences_overlap():
    """What stands together scores alike, wherever in a long sentence it stands."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    insults = ["xirrot", "qumpel", "zorgat", "wuzzip"]
    texts = [" ".join([*(word() for _ in range(12)), *(r.sample(insults, 4) if i % 3 == 0 else [])]) for i in range(300)]
    model = toxicity.train([t.encode() for t in texts], np.array([i % 3 == 0 for i in range(300)]))
    rest = [word() for _ in range(200)]
    scores = model.scores([" ".join(rest[:k] + insults + rest[k:]).encode() for k in range(0, 200, 3)])
    assert scores.min() > 0.5 * scores.max() and scores.min() > toxicity.CUT


def test_repeated_insults_add_up():
    """Insults drawn four times, so that some rows say one of them again and again: of 720 toxic rows, 8 are missed (23 where repeats count once)."""
    insults, missed, wrong = ["idiot", "moron", "clown", "trash"], 0, 0
    y = np.array([i % 5 == 0 for i in range(300)])
    learnt = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300)])
    for seed in range(8, 20):
        r = random.Random(seed)
        word = lambda: "".join(r.choice("abdefghklmnoprstuvw") for _ in range(r.randrange(3, 9)))  # noqa: E731, B023
        prose = lambda: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(120))  # noqa: E731, B023
        texts = [(prose()[:-1] + " " + " ".join(r.choice(insults) for _ in range(4)) + "." if t else prose()).encode() for t in y]
        toxic = toxicity.train([t for t, k in zip(texts, learnt, strict=True) if k], y[learnt]).scores(texts) >= toxicity.CUT
        missed, wrong = missed + (y & ~toxic).sum(), wrong + (toxic & ~y).sum()
    assert missed <= 10 and wrong == 0


# --- pages --------------------------------------------------------------------------------------


def test_pages_against_plain_reading(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for f in html_extract.query(spark, SF).collect():
        inner = re.search("<article>(.*)</article>", html[f["page_id"]], re.S)[1]
        want = " ".join(unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1)>|<br>", " ", inner))).split())
        assert f["text"] == want and f["n_chars"] == len(want)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><h1>A &amp; B</h1><p>x <b>y</b>z<br>w<div class='ad'>AD</div><p>q<aside>no</aside>tail</article><footer>f", "A & B x yz w q tail"),
        ("<nav><ul><li>menu<article>hi</article>", "hi"),
        ("plain < text <3", "plain < text <3"),
        ("<body><div class='comments'>c</div><p>hello<form><input>f</form><span class='ad'>zz</span> x</body>", "hello x"),
        ("<article>1 < 2 &lt;b&gt; &#233;&eacute;</article>", "1 < 2 <b> éé"),
        ("<p>a<!-- no --> b<script>x='</p>'</script>c<style>d</style></p>", "a bc"),
        ("<header>top</header><main><header><h1>Title</h1></header><p title='a>b'>t</p></main>", "Title t"),
    ],
)
def test_markup(html, text):
    page = html_extract.Page(html)
    assert " ".join(t for _, main, _, t in page.blocks if main or not page.has_main) == text


def test_template_text_goes(spark):
    """Pages without an article: what all pages of the host share is template, what fills its slots is text."""
    rows = [(i, f"http://site/{i}", f"<html><body><div><p>Welcome to the site</p><div><p>story {i} of its own</p><p>second {i * 7}</p></div><p>All rights kept</p></div></body></html>") for i in range(30)]
    rows += [(100, "http://alone/1", "<body><p>Welcome to the site</p></body>")]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[7] == "story 7 of its own second 49" and found[100] == "Welcome to the site"
    sent, html_extract.SENT = html_extract.SENT, -1  # the other way: dealt out by parts
    try:
        again = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        html_extract.SENT = sent
    assert again == found


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_only_break_ties(spark):
    """Words of asides in a name drop nothing in an article; names that mean one do; unknown names go by the template."""
    odd = '<div class="share-price"><p>Shares at {i}</p></div><div class="search-results"><p>found {i}</p></div><div class="alert-levels"><p>level {i}</p></div>'
    page = '<html><body><article><h1>Title {i}</h1><div class="xq7"><p>Tell your friends</p></div><p>story {i}</p>' + odd + '<div class="related-posts"><p>other {i}</p></div><div class="comments"><p>I think {i}</p></div></article></body></html>'
    rows = [(i, f"http://site/{i}", page.format(i=i)) for i in range(12)] + [(50, "http://alone/", page.format(i=50))]
    found = extracted(spark, rows)
    assert found[3] == "Title 3 story 3 Shares at 3 found 3 level 3"
    assert found[50] == "Title 50 Tell your friends story 50 Shares at 50 found 50 level 50"


def test_articles_of_the_template_go_before_teasers(spark):
    teaser = '<div class="u"><article><p>teaser {i}</p></article></div>'
    page = '<html><body><div class="z"><article><h1>T {i}</h1><p>story {i}</p></article></div>{more}</body></html>'
    rows = [(i, f"http://site/{i}", page.format(i=i, more=teaser.format(i=i) if i % 4 == 0 else "")) for i in range(12)]
    rows += [(i, f"http://plain/{i}", f'<html><body><div class="price-alert"><p>from {i}</p></div><div><h2>b {i}</h2><p>text {i}</p></div></body></html>') for i in range(20, 29)]
    found = extracted(spark, rows)
    assert found[4] == "T 4 story 4" and found[5] == "T 5 story 5" and found[21] == "b 21 text 21"
    found = extracted(spark, [(1, "http://alone/", rows[4][2]), (2, "http://other/", rows[-1][2])])
    assert found == {1: "T 4 story 4 teaser 4", 2: "from 28 b 28 text 28"}


@pytest.mark.parametrize("tag", ["main", "article"])
def test_template_text_in_main_goes(spark, tag):
    """What all pages of the host share goes from inside main and article elements too."""
    rows = [(i, f"http://site/{i}", f"<html><body><{tag}><p class='x'>Tell your friends of this</p><div><p>story {i} of its own</p></div><p>All rights kept</p></{tag}></body></html>") for i in range(30)]
    found = extracted(spark, rows)
    assert all(found[i] == f"story {i} of its own" for i in range(30))


@pytest.mark.parametrize("tag", ["div", "main"])
def test_copies_are_no_template(spark, tag):
    """A host whose pages are copies of one page keeps its text, and copies beside other pages do not outvote them."""
    page = f"<html><body><{tag}><p>A</p><p>B</p></{tag}></body></html>"
    rows = [(1, "http://two/1", page), (2, "http://two/2", page), (3, "http://row/1", page), (3, "http://row/1", page)]
    own = lambda i: f"<html><body><{tag}><p>top line</p><div><p>story {i}</p></div></{tag}></body></html>"
    rows += [(10 + i, f"http://many/{i}", own(0)) for i in range(20)] + [(40 + i, f"http://many/{40 + i}", own(i)) for i in range(1, 4)]
    found = extracted(spark, rows)
    assert found[1] == found[2] == found[3] == "A B"
    assert found[10] == found[29] == "story 0" and found[41] == "story 1"
    sent, html_extract.COPIED = html_extract.COPIED, -1  # the other way: joined by a shuffle
    try:
        assert extracted(spark, rows) == found
    finally:
        html_extract.COPIED = sent


# --- pieces -------------------------------------------------------------------------------------


def test_viterbi_is_best():
    """The library's own lattice, told that the model is of scored pieces, has the same best segmentation."""
    from sentencepiece import SentencePieceProcessor

    raw = open(piece_codec.default_model(), "rb").read()
    assert raw.count(b"tok_v0\x18\x02") == 1
    lattice = SentencePieceProcessor(model_proto=raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    coder, r = piece_codec.codec(piece_codec.default_model()), random.Random(4)
    words = ["the", "of", "and", "reading", "thnt", "ouheha", "une", "été", "straße", ".", ",", "x" * 9]
    for _ in range(300):
        t = " ".join(r.choice(words) for _ in range(r.randrange(1, 8)))
        mine, best = coder.encode([t])[0].tolist(), lattice.nbest_encode_as_ids(t, 2)[0]
        assert coder.scores[mine].sum() == coder.scores[best].sum()


def test_pieces_round_trip(spark):
    texts = ["", " ", "  a  b ", "日本語🙂", "a\n\tb\r\n", "xx" * 5000, "\x00\x7f́", "new line"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = piece_codec.encode(df, piece_codec.default_model())
    assert all(r["round_trip"] for r in encoded.collect())
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode(encoded, piece_codec.default_model()).collect()} == dict(enumerate(texts))
    assert piece_codec.query(spark, SF).where("not round_trip").count() == 0


# --- quality ------------------------------------------------------------------------------------


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)]


def test_quality_counts(spark):
    r = random.Random(5)
    for _ in range(400):
        t = "".join(r.choice(["a ", "b ", "a b a b ", "\n", "é#", "\x0b", "\x85", "|"]) for _ in range(r.randrange(120)))
        assert quality.count(t.encode())[0] == brute_counts(t)
    docs = documents(spark)
    for f in quality.query(spark, SF).collect():
        want = brute_counts(docs[f["doc_id"]])
        assert [f[b] for b in quality.BASE] == want
        assert f["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (f["base_failed"] and f["kept"])


def test_quality_verdicts(spark):
    sf = "/root/testdata/sf0.1"
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in quality.query(spark, sf).collect() if r["doc_id"] in good]
    kept = lambda q: np.mean([r["kept"] for r in found if good[r["doc_id"]] == q and not r["base_failed"]])
    assert kept(1) > 0.98 and kept(0) < 0.6


def test_quality_on_rows_held_out(spark):
    """Forest and threshold from two thirds of the labelled rows, measured on the others."""
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    good = {r["doc_id"]: r["quality"] for r in known.where("out").collect()}
    found = [r for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), known.where("not out").drop("out")).collect() if r["doc_id"] in good]
    kept = lambda q: np.mean([r["kept"] for r in found if good[r["doc_id"]] == q and not r["base_failed"]])
    print("held out: kept of good", kept(1), "of bad", kept(0))
    assert kept(1) > 0.97 and kept(0) < 0.65


def test_quality_learns_from_every_labelled_row(spark):
    """Bad rows among 6000 labelled ones, all of them beyond the 4000 smallest hashes of ids."""
    r = random.Random(21)
    ids = [x["id"] for x in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    good = lambda: " ".join(word() for _ in range(30)) + "."
    texts = {i: good() if k < 4000 or k % 10 else " ".join(word().upper() + "!#7" for _ in range(30)) for k, i in enumerate(ids)}
    bad = {i for i, t in texts.items() if "#" in t}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = quality.quality(docs, spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int"))
    gone = {f["doc_id"] for f in found.collect() if not f["kept"]}
    print("gone", len(gone & bad), "bad,", len(gone - bad), "good")
    assert len(bad) == 200 and len(gone & bad) > 100 and len(gone - bad) < 58


def test_trees_draw_from_all_rows(spark):
    """Against the least hashes of all rows, in two layouts."""
    r = np.random.default_rng(22)
    rows = r.random((3000, len(quality.STATISTICS)))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows.tolist())], ", ".join(["doc_id long", *(f"{x} double" for x in quality.STATISTICS)]))
    key = np.array([x["k"] for x in df.select("doc_id", F.xxhash64("doc_id", *quality.STATISTICS).alias("k")).orderBy("doc_id").collect()], np.int64).view(np.uint64)
    first, second = (quality.samples(d, 3000) for d in (df.repartition(3), df.orderBy(F.desc("doc_id")).repartition(7)))
    drawn = set()
    for t, (a, b) in enumerate(zip(first, second, strict=True)):
        want = np.argsort(quality._tree_hash(key, t), kind="stable")[: quality.SUBSAMPLE]
        assert (a == rows[want]).all() and (a == b).all()
        drawn.update(want.tolist())
    assert len(drawn) > 2990
    few = quality.samples(df.where("doc_id < 5"), 5)
    assert len(few) == quality.TREES and all(sorted(x[:, 0]) == sorted(rows[:5, 0]) for x in few)


def test_least_cost_over_ranges(spark):
    """As the threshold of the same rows in one piece, with ties, in few and many ranges."""
    r = np.random.default_rng(23)
    for n, steps, rate in ((1, 3, 0.5), (40, 5, 0.5), (3000, 200, 0.6), (3000, 10**6, 0.2), (500, 50, 0.0), (500, 50, 1.0), (2000, 2000, 0.97)):
        s = r.integers(0, steps, n) / steps
        good = r.random(n) < np.where(s > 0.7, rate / 4, rate)
        df = spark.createDataFrame(list(zip(s.tolist(), good.tolist(), strict=True)), "anomaly double, good boolean").repartition(5)
        assert quality.least_cost(df) == quality.threshold(s, good), (n, steps, rate)
