"""Personal data, language ID, BPE, packing and licence scans."""

import hashlib
import itertools
import random
import re
import struct
import sys
import zlib
from pathlib import Path

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from cases import DOCS, ODD, corpus, documents, prose

from kinegrid.llm import bpe, language, licences, packing, pii

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = [(0, m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    out += [(2, m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out += [(3, m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{KINDS[k]}:{a}:{b}" for k, (a, b) in sorted(out)]


TRICKY = [
    "a@b.c_x@d.e a@b.c@d.e x@y z@.w q@r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 9" * 2, "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (974) 555-3436) +49 30 1234567-8. ++123 + 1 +12345678901234567890",
    "\U0001f600é a@b.de é +1 974 555 3436", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok', "call (974) 555-3436 now", "4" * 4000, "a." * 2000 + "@b.c", "@." * 500,
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(2)
    noise = ["".join(rng.choice("a1.@+-() 4é\n") for _ in range(200)) for _ in range(40)]
    texts = TRICKY + ODD + noise
    got = {r.doc_id: r for r in pii.digest(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, r = base_spans(t or ""), got[3 * i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert {*want} <= {*r.spans.split(",")} | {""}


def test_method_adds_and_masks(spark):
    texts = [f'{prose(random.Random(i), 8)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(random.Random(i), 4)}' for i in range(30)]
    texts += [f"write to user{i}@mail.example.com" for i in range(10)] + [prose(random.Random(i), 30) for i in range(40)]
    df = documents(spark, texts)
    got = [r for r in pii.digest(df).collect() if "secret:" in r.spans]
    assert len(got) == 30
    clean = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert sum("<SECRET>" in t for t in clean.values()) == 30 and sum(t == "write to <EMAIL>" for t in clean.values()) == 10
    assert all(clean[3 * i] == t for i, t in enumerate(texts) if i >= 40)
    assert pii.masked(df).columns == df.columns


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "write to a@b.de", 1), (None, None, 2), (3, "write to a@b.de", 3), (3, "write to a@b.de", 4)], "doc_id long, text string, source long")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.digest(df).collect()) == [(0, 0), (0, 1), (3, 1), (3, 1)]
    assert sorted((r.source, r.text) for r in pii.masked(df).collect()) == [(1, "write to <EMAIL>"), (2, None), (3, "write to <EMAIL>"), (4, "write to <EMAIL>")]


def test_reliability_of_labelers():
    """EM tells a good labeler from a random one without labels."""
    rng = random.Random(5)
    rows = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        v = (int(y if rng.random() < 0.95 else not y), int(y if rng.random() < 0.85 else not y), int(y if rng.random() < 0.9 else not y), int(rng.random() < 0.5))
        rows[v] = rows.get(v, 0) + 1
    found = pii.estimate([dict(zip(pii.LABELERS, v)) | {"n": n} for v, n in rows.items()])
    right = {x: (found.given[x][1][1] + found.given[x][0][0]) / 2 for x in pii.LABELERS}
    assert right["pattern"] > 0.9 and right["gazetteer"] > 0.8 and abs(right["shape"] - 0.5) < 0.1 and abs(found.prior - 0.5) < 0.1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.digest(none).count() == 0 and pii.masked(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_decode(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert language.predict(none, language.train(none)).count() == 0
    assert licences.scan(none).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(spark):
    texts = corpus(8, 20) + ["it's I'll  we've\n\n  don't ' s", " \t\n  x  y \n z  ", "日本語　テキスト   x", "\u0085a \u0085 b", "a  ", "\n \n"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = documents(spark, texts).repartition(3)
    got = {r.doc_id: r for r in bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=False).collect()}
    digests = {r.doc_id: r for r in bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert list(got[3 * i].ids) == want and bytes(got[3 * i].decoded) == (t or "").encode()
        assert digests[3 * i].n_tokens == len(want)
        assert digests[3 * i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert digests[3 * i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_packing_places_every_token_once(spark):
    texts = corpus(9, 40) + ["long words here " * 2000]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {3 * i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 512, added=True).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == at.get(r.doc_id, 0) and r.length <= 512 and (r.piece == 0 or r.length == 512)
        at[r.doc_id] = r.start + r.length
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
    assert at == {i: len(x) for i, x in want.items()}
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 512 and len(full) <= 1.05 * sum(full.values()) / 512 + 1


def test_plan_fills_gaps_exactly():
    assert packing.plan({5: 2, 3: 1, 2: 1, 10: 1, 4: 2, 1: 2}, 10)[0] == ((10,), 1)
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        found = packing.plan(dict(histogram), 100)
        used = {}
        for sequence, times in found:
            assert sum(sequence) <= 100 and times > 0
            for x in sequence:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        assert sum(n for _, n in found) <= -(-sum(lengths) // 100) + 2


def test_sum_index_equals_a_search():
    rng = random.Random(3)
    for _ in range(60):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 40), rng.randint(1, 9))}
        index = packing.SumIndex(counts, 60)
        while counts:
            gap = rng.randint(1, 60)
            there = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
            want = next((c for k in (1, 2, 3) for c in itertools.combinations(there, k) if sum(c) == gap), None)
            got = index.exact(gap)
            assert (got is None) == (want is None) and (got is None or (sum(got) == gap and len(got) == len(want) and all(got.count(x) <= counts[x] for x in got) and got[0] == want[0]))
            gone = got or (rng.choice(there),)
            index.take(gone)
            for x in gone:
                counts[x] -= 1
                counts = {k: n for k, n in counts.items() if n}


def languages(seed, n, words=60):
    rng = random.Random(seed)
    syllables = {"aa": ["an", "er", "th", "ing", "re"], "bb": ["sch", "ei", "ung", "kei", "ver"], "cc": ["ción", "os", "ar", "lla", "ñ"]}
    return [(name, " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(words))) for name, s in syllables.items() for _ in range(n)]


def test_language_held_out_and_odd_cases(spark):
    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(languages(1, 30))] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.languages == ["aa", "bb", "cc"]
    held = languages(2, 20, 25)
    odd = [None, "", "123 !!", "日本語", "٣", "a", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in held] + odd)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(df.repartition(3), model).collect()}
    assert sum(got[i].lang_pred == k for i, (k, _) in enumerate(held)) >= 0.95 * len(held)
    assert [got[len(held) + i].lang_pred == "und" for i in range(len(odd))] == [True, True, True, False, True, False, False]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict(df, language.train(train.limit(0))).collect()} == {"und"}


def test_language_equals_a_plain_model(spark):
    """Sets of frequent byte n-grams by language instead of filters; equal labels, and shares within the filters' errors."""
    texts = languages(4, 25, 40)
    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts + texts[:9])], "doc_id long, text string, lang string")

    def grams(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in f" {text} ".encode())
        return [low[i : i + n] for n in (3, 4) for i in range(len(low) - n + 1) if b"  " not in low[i : i + n]]

    counts = {}
    for k, t in dict.fromkeys(texts):
        for g in grams(t):
            counts.setdefault((k, len(g)), {}).setdefault(g, 0)
            counts[k, len(g)][g] += 1
    known = {k: {g for n in (3, 4) for g, c in counts[k, n].items() if c >= 2e-5 * sum(counts[k, n].values())} for k in ("aa", "bb", "cc")}
    asked = [t for _, t in languages(5, 15, 12)] + ["the ung cion", "zzz zzz", "Anther!  sch"]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame([*enumerate(asked)], "doc_id long, text string"), language.train(train)).collect()}
    for i, t in enumerate(asked):
        own = grams(t)
        shares = {k: sum(g in s for g in own) / len(own) for k, s in known.items()}
        best = max(shares.values())
        assert abs(got[i].score - best) < 0.05 and shares[got[i].lang_pred] >= best - 0.05


def test_filter_returns_all_languages_of_a_gram():
    model = language.build_filter([("a", 7), ("b", 7), ("b", 9), *(("c", k) for k in range(1000, 3000))], {"a": 1, "b": 1, "c": 1})
    import numpy as np

    masks = model.masks(np.array([7, 9, 1500], np.uint64), 0)
    assert masks[0] & 3 == 3 and masks[1] & 2 and masks[2] & 4
    other = model.masks(np.arange(10_000, 60_000).astype(np.uint64), 0)
    assert abs((other >> np.uint64(2) & np.uint64(1)).mean() - model.false_rate[2]) < 0.01


SENTENCES = {
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY-ND 4.0.": "cc-by-nd", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa", "Licensed under CC BY 4.0": "cc-by",
    "Released under the ISC License.": "isc", "Released under the BSD License.": "bsd", "Distributed under the BSD 3-Clause License.": "bsd-3-clause", "Eclipse Public License, version 2.0": "epl", "SPDX-License-Identifier: AGPL-3.0-only": "agpl", "Not licensed under the Apache License": "",
    "This is not licensed under the Apache License, Version 2.0.": "", "Licensed under the Artistic License 2.0.": "", "Licensed under the Zope Public License 2.1": "", "We never released it under the MIT License.": "", "MIT is a school": "", "a permission is not granted to the apache tribe": "",
    "The license plate of the version 2.0 car was under the general public bench.": "", "we spoke of the mit license in class today with all the students": "", "Licensed under CC BY NC SA 4.0": "",
}


def test_licences(spark):
    rng = random.Random(4)
    texts = [prose(rng, 50) + "\n" + line + "\n" + prose(rng, 20) for line in SENTENCES for _ in range(2)] + [prose(rng, 60) for _ in range(40)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, texts + ODD)).collect()}
    wanted = [k for k in SENTENCES.values() for _ in range(2)]
    assert {texts[i].split("\n")[1]: got[3 * i].licences for i in range(len(wanted))} == SENTENCES
    assert all(r.licences == "" and r.n_licence == 0 and r.confidence == 0 for i, r in got.items() if i >= 3 * len(wanted))


def test_licence_scan_equals_looking_at_every_line(spark):
    """Without the cues and words that decide what is looked at."""
    rng = random.Random(6)
    model = licences.train([prose(rng, 12) for _ in range(60)])
    known = [" ".join(t.tokens) for t in licences.templates()]
    texts = []
    for _ in range(60):
        rows = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(known).split()
            rows.insert(rng.randrange(len(rows) + 1), rng.choice(["", "not ", "- "]) + " ".join(w for w in line if rng.random() > 0.1) + rng.choice(["", ".", " " + prose(rng, 90)]))
        texts.append("\n\n".join(rows))
    judge = licences.Judge(model, 0.5, 0.75)
    got = {r.doc_id: r for r in licences.scan(documents(spark, texts), classifier=model).collect()}
    for i, t in enumerate(texts):
        verdicts = [[v for w in licences.windows(licences.sentence_words(p)) if (v := judge(w))] for p in t.split("\n") if p.strip()]
        found = [max(v, key=lambda v: v[1]) for v in verdicts if v]
        assert (got[3 * i].n_licence, got[3 * i].licences) == (len(found), ",".join(sorted({licences.FAMILIES[k] for k, _ in found})))
        assert got[3 * i].confidence == max((c for _, c in found), default=0.0)
    assert sum(r.n_licence > 0 for r in got.values()) > 20


def test_wrapped_licences(spark):
    import textwrap

    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nYou should have received a copy of the GNU General Public License along with this program.",
        "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    }
    rng = random.Random(9)
    cases = []
    for name, text in texts.items():
        for width in (40, 72, 80):
            for mark in ("", "# ", "// ", " * "):
                rows = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n")).split("\n")
                cases.append((name, prose(rng, 30) + "\n\n" + "\n".join((mark + x).rstrip() for x in rows) + "\n\n" + prose(rng, 30), text.count("\n\n") + 1))
    cases += [("mit", prose(rng, 9) + " released under\nthe MIT License. " + prose(rng, 9), 1), ("mit", "# Released under the MIT License.\n# " + prose(rng, 9), 1)]
    clean = [prose(rng, 9) + "\n" + prose(rng, 9), "the license\nof a permission\nis copyright of the software", "a permission is granted\nto the apache tribe\nunder the version", "released\n\nunder the\n\nMIT"]
    got = {r.doc_id: r for r in licences.scan(documents(spark, [t for _, t, _ in cases] + clean)).collect()}
    # the text's last clause is that of the licence of three
    assert [got[3 * i].licences for i in range(len(cases))] == ["bsd,bsd-3-clause" if name == "bsd" else name for name, _, _ in cases]
    assert [(i, n, got[3 * i].n_licence) for i, (_, _, n) in enumerate(cases) if not n - 1 <= got[3 * i].n_licence <= n + 1] == []
    assert all(got[3 * i].licences == "" and got[3 * i].n_licence == 0 for i in range(len(cases), len(cases) + len(clean)))


def test_op10_and_pipeline_have_the_ids_of_the_unmodified_tokenizer(spark, tmp_path):
    import corpus_pipeline

    from kinegrid.llm.queries import QUERIES

    texts = corpus(10, 12) + ["end<|endoftext|>x", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>  a", "<|endoftext|", "<<|endoftext|>>", "x  <|endoftext|>  y"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {3 * i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert sum(50256 in x for x in want.values()) >= 6
    df = documents(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for found in (QUERIES["op10_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, df, str(tmp_path))):
        rows = found.collect()
        assert {i: sum(r.length for r in rows if r.doc_id == i) for i in want} == {i: len(x) for i, x in want.items()}
        for r in rows:
            ids = want[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
