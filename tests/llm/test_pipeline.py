"""The pipeline's stages and run() against plain versions, on a small corpus with planted cases."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
from test_neardup_recall import edited, plain_classes
from test_parts import plain_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from loomkit.llm import encode, quality
from loomkit.llm.common import table

VOCABULARY = [f"{a}{b}" for a in ("stone", "river", "cloud", "amber", "lantern", "meadow", "quiet", "bright") for b in ("", "s", "ly", "ward", "less", "en")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"


def sentence(r: random.Random) -> str:
    return " ".join(r.choices(VOCABULARY, k=r.randint(6, 14))).capitalize() + "."


def noise(r: random.Random) -> str:
    return " | ".join("###" + w.upper() + "$$$" for w in r.choices(VOCABULARY, k=9))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: good and bad documents, near copies, benchmark passages, secrets, nulls and empty texts."""
    r, texts = random.Random(31), []
    for _ in range(40):
        texts.append("\n".join(sentence(r) for _ in range(r.randint(8, 14))))
    for _ in range(15):
        texts.append("\n".join([sentence(r)] + [noise(r) for _ in range(8)] + [sentence(r)]))
    for k in range(12):
        words = texts[k].split()
        texts.append(" ".join(edited(words, r.choice([0, 1, len(words) // 12, len(words) // 4]), r)))
    items = [" ".join(r.choices([w + "x" for w in VOCABULARY], k=14)) for _ in range(3)]
    for k in range(3):
        texts.append("\n".join(sentence(r) for _ in range(9)) + " " + items[k] + " " + sentence(r))
    for k in range(4):
        texts.append("\n".join(sentence(r) for _ in range(9)) + f"\npassword = 'q8RtZ{k}lmW2pXy7' AKIAABCDEFGHIJKLMN{k}.")
    texts += [None, "", "Too short.", " ".join(sentence(r) for _ in range(2000)), texts[5]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), f"x{i}") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[7], "en", "s", 1, "null id")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 40 else 0) for i in range(55)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"file://{path}", rows, items


def plain_quality(rows: list, weights) -> list:
    """Words and windows counted plainly; labels by trying all of a short text's labellings, else by Viterbi over a list."""
    kept = []
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(words) < 3000 else set()
        covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 3)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            continue
        lines, seen, scores, sizes = row[1].split("\n"), set(), [], []
        for line in lines:
            here = re.findall(r"[^\x20\x09-\x0D]+", line)
            if here:
                scores.append((quality.matrix([quality.line_features(line, here, line in seen)]) @ weights.lines.T)[0])
                sizes.append(len(here))
                seen.add(line)
        best = [(scores[0][y], [y]) for y in (0, 1)]
        for s in scores[1:]:
            best = [max(((v + weights.moves[path[-1], y] + s[y], [*path, y]) for v, path in best), key=lambda x: x[0]) for y in (0, 1)]
        labels = max(best, key=lambda x: x[0])[1]
        if sum(n for n, y in zip(sizes, labels) if y) / len(words) >= quality.SHARE:
            kept.append(row)
    return kept


def plain_representatives(rows: list) -> list:
    found = dict(plain_classes([(k, r[1] or "") for k, r in enumerate(rows)]))
    groups: dict[int, list] = {}
    for k, r in enumerate(rows):
        groups.setdefault(found[k], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_decontaminated(rows: list, items: list) -> list:
    windows = {tuple(words(t)[i : i + 10]) for t in items for i in range(len(words(t)) - 9)}
    return [r for r in rows if not any(tuple(words(r[1])[i : i + 10]) in windows for i in range(len(words(r[1])) - 9))]


def plain_redacted(rows: list) -> list:
    out = []
    for r in rows:
        text = r[1]
        if text and (spans := plain_secrets(text)):
            for a, b in reversed(merged([(s, e) for _, s, e in spans])):
                text = text[:a] + "[secret]" + text[b:]
            r = (r[0], text, r[2], r[3], len(text), r[5])
        out.append(r)
    return out


def merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def as_rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_and_run(spark, corpus):
    path, rows, items = corpus
    docs = table(spark, path, "documents")
    weights = quality.train(docs, table(spark, path, "labels"))
    wanted = sorted(plain_quality(rows, weights), key=str)
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    got = stages[names[0]](spark, docs, path)
    assert got.columns == docs.columns and as_rows(got) == wanted
    kept = {r[0] for r in wanted}
    assert set(range(40)) <= kept and not kept & set(range(40, 55))  # clean documents stay, those of noise go

    docs = spark.createDataFrame(wanted, SCHEMA).repartition(3)
    wanted = sorted(plain_representatives(wanted), key=str)
    got = as_rows(stages[names[1]](spark, docs, path))
    assert got == wanted

    docs = spark.createDataFrame(wanted, SCHEMA).repartition(3)
    before, wanted = len(wanted), sorted(plain_decontaminated(wanted, items), key=str)
    assert as_rows(stages[names[2]](spark, docs, path)) == wanted and len(wanted) == before - 3

    docs = spark.createDataFrame(wanted, SCHEMA).repartition(3)
    before, wanted = wanted, sorted(plain_redacted(wanted), key=str)
    assert as_rows(stages[names[3]](spark, docs, path)) == wanted and sum(a != b for a, b in zip(before, wanted)) >= 4

    check_pieces(corpus_pipeline.run(spark, path).collect(), wanted)


def check_pieces(pieces: list, rows: list) -> None:
    """Each id of each document in one piece, sequences without gaps, at most 2,048 ids, little padding."""
    lib, want, got, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}, {}
    for r in rows:
        want[r[0]] = lib.encode(r[1] or "", add_special_tokens=False).ids + [1]
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(got) == set(want)
    import zlib

    for doc, ids in want.items():
        own = sorted(got[doc], key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(encode.packed(ids[p.start : p.start + p.length])) for p in own)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and sum(p.length for p in own) <= 2048


def test_stages_on_empty_tables_and_nulls(spark, corpus):
    path, _, _ = corpus
    none = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", None, None, None, None), (1, "", None, None, None, None)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0, name
        n = stage(spark, odd, path).count()
        assert n == {"quality rules": 0, "near-duplicates": 1}.get(name, 3), (name, n)
