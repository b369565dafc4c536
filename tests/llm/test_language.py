from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pytest

from ledgerloom.llm import language

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    got = language.op8_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_and_names_play_no_part(spark, make):
    rows = [
        (i, "the quick brown fox and the dog " * 3 if i % 2 else "der schnelle braune fuchs und der hund " * 3, "en" if i % 2 else "de")
        for i in range(100)
    ]
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(make(x)).collect()} for x in (rows, changed))
    assert a == b and all(a[i][0] == ("en" if i % 2 else "de") for i in range(100))


def test_families_and_many_languages(make):
    samples = {
        "en": "the house and the garden of the king",
        "de": "das haus und der garten des koenigs",
        "fr": "la maison et le jardin du roi avec",
        "es": "la casa y el jardin del rey con una",
        "ru": "дом и сад царя и ещё",
        "xx": "qwx zzk vvp kkq wxz",
    }
    rows = [(n * 10 + k, f"{text} {text.split()[k % 5]}", lang) for n in range(12) for k, (lang, text) in enumerate(samples.items())]
    got = {r.doc_id: r.lang_pred for r in language.identify(make(rows)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_odd_rows(odd, none, make):
    got = language.identify(odd).collect()
    assert len(got) == 13 and sum(r.lang_pred == "und" and r.score == 0.0 for r in got) == 6
    assert {r.lang_pred for r in got} == {"und", "en"}
    assert sorted(str(r.doc_id) for r in language.keep_known(odd).collect()) == ["10", "4", "5", "5", "6", "7", "None"]
    assert language.identify(none).count() == 0 and language.keep_known(none).count() == 0
    unlabelled = make([(1, "some text", None), (2, None, None), (3, "12", None)])
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    kept = language.keep_known(unlabelled)
    assert kept.columns == unlabelled.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3}  # nothing learned


def two_languages(n=100):
    texts = {"en": "the quick brown fox and the dog ", "de": "der schnelle braune fuchs und der hund "}
    return [(i, texts[lang] * (1 + i % 3), lang) for i in range(n) for lang in ("en" if i % 2 else "de",)]


def test_the_prediction_decides_what_stays(make):
    wrong = next(i for i in range(202, 300) if zlib.crc32(str(i).encode()) % 5 == 0)  # its label isn't learned from
    rows = two_languages() + [(200, "the dog and the fox", None), (201, "der hund und der fuchs", None), (wrong, "der hund und der fuchs", "en")]
    docs = make(rows)
    kept = {r.doc_id: r.lang for r in language.keep_known(docs).collect()}
    assert len(kept) == 103 and kept[200] == "en" and kept[201] == "de" and kept[wrong] == "en"
    only = {r.doc_id for r in language.keep_known(docs, languages={"en"}).collect()}
    assert only == {i for i, t, _ in rows if "the" in t}  # by the text, not by the label
    assert language.keep_known(docs, least=1.1).count() == 0
    scores = {r.doc_id: r.score for r in language.identify(docs).collect()}
    cut = sorted(scores.values())[50]
    assert {r.doc_id for r in language.keep_known(docs, least=cut).collect()} == {i for i, v in scores.items() if v >= cut}


def test_whole_query_is_brute_force(make):
    """Every row's prediction from the learned weights, with features counted one by one."""
    rows = two_languages(60) + [
        (300 + i, f"la maison du roi et le jardin {i}", "fr")
        for i in range(20)
    ] + [(400, "Hund - FOX, 12", None), (401, "12 ..", "en"), (402, None, "en")]
    model = language.learn(make(rows))

    def naive(text):
        clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        line = (" " + " ".join(clean.split()) + " ").encode()
        if line.strip() == b"":
            return "und", 0.0
        counts = [0] * language.DIM
        for i in range(len(line) - 2):
            a, b, c = line[i : i + 3]
            counts[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        x = [(c / (len(line) - 2)) ** 0.5 for c in counts]

        def best_of(machines):
            if len(machines.classes) == 1:
                return machines.classes[0], 1.0
            votes, sums, least = ({c: 0.0 for c in machines.classes} for _ in range(3))
            least = {c: float("inf") for c in machines.classes}
            for (a, b), (w, bias) in machines.pairs.items():
                m = sum(u * v for u, v in zip(x, w.tolist(), strict=True) if u) + bias
                votes[a if m >= 0 else b] += 1
                for c, v in ((a, m), (b, -m)):
                    sums[c] += v
                    least[c] = min(least[c], v)
            best = max(machines.classes, key=lambda c: (votes[c], sums[c]))
            return best, 1 / (1 + math.exp(-2 * least[best]))

        family, sure = best_of(model.families)
        lang, within = best_of(model.within[family])
        return lang, sure * within

    got = language.identify(make(rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        lang, score = naive(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_many_unlisted_codes_need_few_machines():
    r = np.random.default_rng(1)
    codes = [f"x{i:02d}" for i in range(64)]
    x = np.abs(r.normal(size=(64, language.DIM))) + 100 * np.eye(8, language.DIM)[np.arange(64) % 8]
    x = np.repeat(x / np.linalg.norm(x, axis=1, keepdims=True), 2, axis=0)
    family = language.families_of(x, np.array([c for c in codes for _ in range(2)], dtype=object))
    assert set(family) == set(codes) and len(set(family.values())) == 8
    assert all(family[a] == family[b] for a, b in zip(codes, codes[8:], strict=False))


def test_numerals_are_no_letters():
    assert all(language.letters_of(t) == b"" for t in (None, "", "½ ² 12_3", "..."))
    assert language.letters_of("½ A1b") == " ½ a b ".encode()
