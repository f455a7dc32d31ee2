"""The operators' parts that need no Spark, against plain versions and the libraries themselves."""

import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkit.llm import automata, decontaminate, encode, licenses, neardup, packing, quality, repeats, secrets, suffixes, tokens, toxicity

PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "The", " ", "  ", "\n", "é", "日本", "<s>", " ", "\t", "x", " of", "tion", "\x00", "'s", "12", "<|endoftext|>", "İ", "Σ", " ", "\u0085", "\x1d", "!!", "é", ".", "\n\n", "²", "ß", "ñ", "▁"]


def mixed_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 10))) for _ in range(n)]


def test_token_counts_are_the_librarys():
    sp, lengths = sentencepiece.SentencePieceProcessor(model_file=PIECE), tokens.Lengths(PIECE, tokens.lengths(PIECE, ["The", "a", "é", "\n\n", "tion"]))
    for t in mixed_texts(4000, 1):
        assert lengths.count(t) == len(sp.encode(t)), t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    e = encode.Encoder(public_tokenizers.path(name))
    for t in [*mixed_texts(4000, 2), "word " * 3000, "x" * 5000]:
        assert e.encode(t) == e.whole(t), t[:50]


def test_windows_hold_every_id_once():
    r, done = random.Random(3), []
    w = packing.Windows(64, 4, done.append)
    docs = {i: struct.pack(f"<{n}I", *range(n)) for i, n in enumerate(r.randint(1, 200) for _ in range(300))}
    for i, ids in docs.items():
        w.add(i, ids)
        assert len(w.open) <= 4
    left = list(packing.poured((p for _, ps in w.open for p in ps), 64))
    assert all(sum(len(p[2]) for p in x) == 256 for x in left[:-1])
    last = list(packing.powers(left[-1]))
    assert all((n := sum(len(p[2]) for p in x) // 4) & (n - 1) == 0 for x in last)
    got = {}
    for x in [*done, *left[:-1], *last]:
        assert sum(len(p[2]) for p in x) <= 256
        for doc, start, ids, total in x:
            assert total == len(docs[doc]) // 4
            got.setdefault(doc, []).append((start, ids))
    assert {d: b"".join(ids for _, ids in sorted(ps)) for d, ps in got.items()} == docs
    padded = sum(64 - sum(len(p[2]) for p in x) // 4 for x in done)
    assert padded < 0.1 * sum(len(d) // 4 for d in docs.values())


PATTERNS = ["a", "ab?c", "(a|bc)+d", "[a-c]{2,4}", "(?i:ab)c*", "a{3,}", "x\\x20*[=:]+y", "[^a-y]z"]


@settings(max_examples=150, deadline=None)
@given(st.text("abcdxyzAB =:", max_size=14))
def test_automata_accept_what_regexes_do(t):
    for p in PATTERNS:
        forward = automata.compiled(p)
        m = re.match(p, t)
        longest = max((e for e in range(len(t) + 1) if re.fullmatch(p, t[:e])), default=-1)
        assert forward.run(t.encode()) == longest and (m is None) == (longest < 0)
        back = max((len(t) - s for s in range(len(t) + 1) if re.fullmatch(p, t[s:])), default=-1)
        assert automata.compiled(p, backward=True).run(t.encode(), backward=True) == back


def test_scanner_finds_all_ends():
    ps = ["ab+", "b[cd]", "dd"]
    scan, r = automata.Scanner(automata.combined(ps)), random.Random(4)
    for lanes in (1, 7, 1000):
        t = "".join(r.choice("abcd,\n") for _ in range(3000)) + "\n"
        places, bits = scan.ends(t.encode(), lanes)
        want = {}
        for k, p in enumerate(ps):
            for e in range(1, len(t) + 1):
                if any(re.fullmatch(p, t[s:e]) for s in range(max(0, e - 12), e)):
                    want[e - 1] = want.get(e - 1, 0) | 1 << k
        got = dict(zip(places.tolist(), bits.tolist()))
        assert {k for k in got if k < 3000} == set(want) and all(got[k] & want[k] == want[k] for k in want)


@pytest.mark.parametrize("lanes", [1, 2, 9, 64])
def test_scanner_follows_states_over_lanes(lanes):
    """Matches as long as many lanes, and texts in which no byte leads back to the start."""
    ps = ["t=[a-z]+", "[0-9a-f]{4,}", "xx"]
    scan, whole = automata.Scanner(automata.combined(ps)), automata.Scanner(automata.combined(ps))
    r = random.Random(22)
    for _ in range(30):
        t = ("".join(r.choice(["t=", "x", "ab", "1", "z" * 200, "feed" * 30]) for _ in range(r.randint(0, 60))) + "\n").encode()
        got, want = scan.ends(t, lanes), whole.ends(t, 1)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_two_megabytes_without_a_break_are_scanned_at_once():
    import time

    r, found = random.Random(23), secrets.detector(secrets.RULES)
    for t in ("".join(r.choices("ABCDEFGHabcdefgh0123+/", k=2_000_000)), " ".join(r.choices(["word", "token", "secret", "deadbeef", "pass"], k=350_000))):
        start = time.time()
        assert found.scan([t]) == [plain_secrets(t)]
        assert time.time() - start < 20  # a lane alone took longer for the scan


def plain_secrets(t: str) -> list:
    """The base rules by Python's regular expressions, and the others likewise."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    for k, rule in enumerate(secrets.RULES[3:], 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, t) if not rule.head or len(m[0]) - len(re.match(rule.head, m[0])[0]) >= rule.least]
    return [(secrets.RULES[k].kind, s, e) for s, k, e in sorted(out)]


def test_secrets_as_plain_regexes():
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", "PassWd", " ", "=", ":", "'", '"', "abcdefghijkl", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "dead", "-", "\n", ".", "ghp_" + "a" * 36, "eyJ", "eyJabc.", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "日"]
    r = random.Random(5)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)] + [None, "", "f" * 100_000, "token=" + "x" * 50_000]
    for t, got in zip(texts, secrets.detector(secrets.RULES).scan(texts)):
        assert got == plain_secrets(t or ""), t and t[:80]


def test_windows_of_benchmarks_as_plain_search():
    r = random.Random(6)
    words = lambda n: " ".join(r.choice(["Aa", "b", "c1", "é"]) for _ in range(n))
    items = [(i, words(r.choice([0, 1, 2, 5, 10, 14]))) for i in range(30)] + [(None, "zz zz"), (40, None)]
    match = decontaminate.Matcher(items).match
    for _ in range(300):
        t = words(r.randint(0, 60))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit, found = set(), set()
        for i, text in items:
            b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
            k = min(10, len(b))
            for s in range(len(b) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {i} - {None}
        n, spans, ids = match(t)
        assert n == len(w) and {p for a, b in spans for p in range(a, b)} == hit and ids == sorted(found)


def plain_of(template: str, fill: str = "") -> list[str]:
    """A template's wording without its optional regions, its replaceable ones filled."""
    return licenses.MARKUP.sub(f" {fill} ", re.sub(r"<<opt>>.*?<<end>>", " ", template, flags=re.S)).split()


def test_templates():
    found = licenses.Templates([*licenses.PHRASES, *licenses.TEMPLATES])
    both = [*licenses.PHRASES, *licenses.TEMPLATES]
    labels = lambda t: sorted({both[k][0] for k, _, _ in found.find(licenses.words(t))})
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    for k, (label, template) in enumerate(licenses.TEMPLATES, len(licenses.PHRASES)):
        at = lambda t, k=k: [(s, e) for j, s, e in found.find(licenses.words(t)) if j == k]
        own = " ".join(plain_of(template, "Jane Doe"))
        assert at("See here. " + own + " The end.") and label in labels(own), label
    bsd = next(t for name, t in licenses.TEMPLATES if name == "bsd-3-clause")
    assert labels(" ".join(plain_of(bsd, "x " * 9))) == [] and labels(" ".join(plain_of(bsd, "x " * 8))) == ["bsd-3-clause"]
    assert found.find([]) == []
    with pytest.raises(ValueError):
        licenses.Templates([("x", "<<opt>>all<<end>>")])


@pytest.mark.parametrize("label", ["mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense", "gpl-3", "gpl-2"])
def test_altered_wording_anywhere_is_refused(label):
    template = next(t for name, t in licenses.TEMPLATES if name == label)
    found, whole = licenses.Templates([(label, template)]), [w.decode() for w in licenses.words(" ".join(plain_of(template, "Jane")))]
    jane = {i for i, w in enumerate(whole) if w == "jane"}
    assert found.find([w.encode() for w in whole])
    for i in set(range(len(whole))) - jane:
        for changed in (whole[:i] + ["other"] + whole[i + 1 :], whole[:i] + whole[i + 1 :]):
            if changed != whole and not (i + 1 in jane or i - 1 in jane):  # beside a name the name may take the word
                assert not found.find([w.encode() for w in changed]), (label, i, whole[i])


def test_base_phrases_as_plain_search():
    r, found = random.Random(24), licenses.Templates([*licenses.PHRASES, *licenses.TEMPLATES])
    for _ in range(500):
        w = r.choices(["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x"], k=r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(licenses.PHRASES)[1].split()
        want = sorted((k, i) for k, (_, p) in enumerate(licenses.PHRASES) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted((k, s) for k, s, _ in found.find([x.encode() for x in w]) if k < len(licenses.PHRASES)) == want


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 6))
def test_alignment_in_a_band(a, b, most):
    assert neardup.within(a, b, most) == (distance(a, b) <= most)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12), st.integers(0, 13))
def test_words_in_common(a, b, least):
    common = sum(min(a.count(w), b.count(w)) for w in set(a))
    assert neardup.enough_alike(neardup.counted(a), b, least) == (common >= least)


def test_words_have_hashes_of_their_own():
    w = [b"", b"a", b"b", b"ab", b"ba", b"aa", b"a" * 5000, b"a" * 5001, b"b" + b"a" * 4999, *(f"w{i}".encode() for i in range(5000))][1:]
    h = neardup.word_hashes(w)
    assert len(set(h.tolist())) == len(w) and (neardup.word_hashes(w[::-1]) == h[::-1]).all() and len(neardup.word_hashes([])) == 0


def test_sketches_keep_the_order_of_the_text():
    w = [f"w{i}".encode() for i in range(40)]
    s = neardup.shingle_hashes(w)
    same, turned = neardup.sketches(s), neardup.sketches(s[::-1].copy())
    assert (same == neardup.sketches(s.copy())).all() and (same != turned).all()
    assert len(set(neardup.shingle_hashes([b"a"] * 30).tolist())) == 26  # occurrences count
    assert neardup.sketches(neardup.shingle_hashes([b"one"])).shape == (neardup.BANDS,)


def test_sketches_in_parts(monkeypatch):
    s = neardup.shingle_hashes([f"w{i % 70}".encode() for i in range(300)])
    whole = neardup.sketches(s)
    monkeypatch.setattr(neardup, "AT_ONCE", 1000)
    assert (whole == neardup.sketches(s)).all()


def test_base_counts():
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 3)}
        return w, dup, len(hit)

    r = random.Random(7)
    for _ in range(200):
        t = "".join(r.choice(["a ", "b ", "c\n", "\n", "#x ", "\x0b", " ", "é "]) for _ in range(r.randint(0, 60)))
        w, dup, hit = plain(t)
        found = quality.read_lines(t)
        assert found.again == dup and quality.repeated_words(found.words, found.kinds) == hit and sum(found.sizes) == len(w)
        assert found.chars == sum(map(len, w)) and found.kinds == len(set(w)) and [w.index(x) for x in w] == [found.words.tolist().index(i) for i in found.words]


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(8)
    for _ in range(50):
        scores, moves = r.normal(size=(6, 2)), r.normal(size=(2, 2))
        total = lambda y: sum(scores[i, a] for i, a in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        best = max(total([(k >> i) & 1 for i in range(6)]) for k in range(64))
        assert abs(total(quality.viterbi(scores, moves)) - best) < 1e-9


def test_sums_are_those_of_all_labellings():
    r = np.random.default_rng(9)
    docs = [r.integers(0, 1 << len(quality.FEATURES), n).tolist() for n in (4, 1, 3, 4)]
    weights = quality.Weights(r.normal(size=(2, len(quality.FEATURES))) / 3, r.normal(size=(2, 2)))
    chains = quality.Chains(docs)
    lines, pairs, Z, content = chains.sums(weights)
    for k, i in enumerate(chains.order):
        scores, n = quality.matrix(docs[i]) @ weights.lines.T, len(docs[i])
        total = lambda y: sum(scores[t, a] for t, a in enumerate(y)) + sum(weights.moves[a, b] for a, b in zip(y, y[1:]))
        every = [[(m >> t) & 1 for t in range(n)] for m in range(1 << n)]
        odds = np.exp([total(y) for y in every])
        assert np.isclose(Z[k], np.log(odds.sum())) and np.isclose(content[k], total([1] * n))
        for t in range(n):
            at = chains.at[t] + k
            assert np.isclose(lines[at, 1], sum(p for p, y in zip(odds, every) if y[t]) / odds.sum())
            if t:
                assert np.isclose(pairs[at - chains.live[0], 0, 1], sum(p for p, y in zip(odds, every) if not y[t - 1] and y[t]) / odds.sum())


GOOD, BAD = "The quick brown fox walks over the hill.", "### buy | now *** $$$ | click | here &&&"


def labelled(line: str) -> int:
    return quality.line_features(line, line.split(), False)


def test_field_finds_lines_of_either_kind_inside_documents():
    """Bad documents have plain lines too, and only documents have labels; planted borders are found."""
    r = random.Random(21)
    plain = lambda: labelled(" ".join(r.choices(["The", "river", "runs", "Slowly", "under", "bridges"], k=r.randint(4, 20))) + ".")
    noise = lambda: labelled(" ".join(r.choices(["###", "buy***", "$$$now", "|", "WIN!!", "&&&"], k=r.randint(4, 20))))
    mixed = lambda: [plain() for _ in range(r.randint(1, 4))] + [noise() for _ in range(r.randint(3, 9))] + [plain() for _ in range(r.randint(0, 3))]
    w = quality.fit([([plain() for _ in range(r.randint(1, 12))], 1) for _ in range(200)] + [(mixed(), 0) for _ in range(60)])
    right = total = 0
    for _ in range(100):
        kinds = [1] * r.randint(1, 6) + [0] * r.randint(1, 6) + [1] * r.randint(0, 4)
        found = quality.viterbi(quality.matrix([plain() if k else noise() for k in kinds]) @ w.lines.T, w.moves)
        right, total = right + sum(a == b for a, b in zip(found, kinds)), total + len(kinds)
    assert right > 0.97 * total


def test_field_tolerates_one_label_and_long_documents():
    w = quality.fit([([labelled(GOOD)] * 5, 1), ([labelled(BAD)] * 5, 0)] * 20)
    assert quality.viterbi(quality.matrix([labelled(GOOD)] * 3 + [labelled(BAD)] * 3) @ w.lines.T, w.moves) == [1, 1, 1, 0, 0, 0]
    one = quality.fit([([labelled(GOOD)], 1)])
    assert quality.viterbi(quality.matrix([labelled(BAD)]) @ one.lines.T, one.moves) == [1]
    long = quality.stretches(list(range(100_000)))
    assert len(long) == quality.STRETCHES and all(len(x) == quality.STRETCH for x in long) and long[-1][0] > 70_000
    assert quality.stretches([1, 2]) == [[1, 2]] and quality.stretches([]) == []


def test_classifier_on_planted_words():
    r, f = random.Random(9), toxicity.Features()
    make = lambda bad: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(40)) + (" vile" if bad else "")
    rows, labels = zip(*((f.of(make(k % 5 == 0)), int(k % 5 == 0)) for k in range(400)))
    labels = np.array(labels)
    model = toxicity.fit(list(rows), labels, np.arange(400) % 4 == 0)
    assert ((toxicity.raw(model, list(rows)) > 0) == (labels == 1)).mean() > 0.99
    assert f.of("").tolist() == f.of(None).tolist()
    alike = toxicity.fit(list(rows[:3]), np.zeros(3, np.int64), np.zeros(3, bool))
    assert (toxicity.raw(alike, list(rows)) < 0).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(values):
    s = np.array(values)
    sa = suffixes.suffix_array(s, 4)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: values[i:])
    data = np.concatenate([s.astype(np.uint8), np.zeros(60, np.uint8)])
    common = suffixes.permuted_prefixes(data, sa, 40)
    for a, b in zip(sa, sa[1:]):
        n = next((k for k in range(40) if data[a + k] != data[b + k]), 40)
        assert common[b] == n


@pytest.mark.parametrize("dense", [0, 64, 1 << 40])
def test_suffix_array_of_a_large_alphabet(dense, monkeypatch):
    monkeypatch.setattr(suffixes, "DENSE", dense)
    r = random.Random(20)
    phrases = [bytes(r.randrange(97, 123) for _ in range(r.randint(3, 30))) for _ in range(400)]
    data = b"".join(r.choice(phrases) for _ in range(2500))
    sigmas, plain = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s, sigma: sigmas.append(sigma) or plain(s, sigma))
    sa = suffixes.suffix_array(np.frombuffer(data, np.uint8).astype(np.int64), 256)
    assert sorted(sa.tolist()) == list(range(len(data))) and all(data[a:] < data[b:] for a, b in zip(sa, sa[1:]))
    assert max(sigmas[1:]) > 1024 and len(sigmas) > 2  # recursion over more than 1,024 names, and again


def test_equal_windows_have_equal_fingerprints():
    r = random.Random(10)
    shared = bytes(r.randrange(97, 101) for _ in range(90))
    texts = [bytes(r.randrange(97, 123) for _ in range(r.randint(0, 80))) + shared + bytes(r.randrange(97, 123) for _ in range(30)) for _ in range(20)] + [b"", b"ab" * 100, b"x" * 49, b"x" * 50]
    prints, of, first, windows, gram = repeats.contexts(texts)
    by_window = {}
    for p, t, f, w, g in zip(prints, of, first, windows, gram):
        for k in range(f, f + w):
            by_window.setdefault(texts[t][k : k + 50], set()).add(int(p))
            assert k <= f + g <= k + 30
    assert all(len(p) == 1 for p in by_window.values())
    assert sum(windows) == sum(max(0, len(t) - 49) for t in texts)
