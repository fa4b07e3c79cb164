"""Chat formatting, repetition rules, language ID, quality, BPE and packing against brute force and on edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge_cases import SF001, edge_docs, no_docs  # noqa: F401
from tokenizers import Tokenizer

from seqloom.llm import chat_format as C
from seqloom.llm.bpe_automaton import Codec, MergeAutomaton, decode_documents, encode_documents, read_tokenizer
from seqloom.llm.hilbert_packing import hilbert_keys, pack_documents
from seqloom.llm.language_id import identify_languages, learn_profiles
from seqloom.llm.quality_compression import fit, hash_order, learn_quality, score_quality
from seqloom.llm.repetition_rules import keep_documents, repetition_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---- chat formatting


def render(source, turns):
    chunks = list(C.ChatTemplate(source).render(iter(turns)))
    return "".join(t for t, _ in chunks)


def test_template_language():
    source = "{% for turn in turns %}{% if loop.first %}[{% elif loop.last %}({% else %}-{% endif %}{{ turn.role + ':' | upper }}{{ turn.text | trim }}{% endfor %}!"
    assert render(source, [("a", " x "), ("b", "y"), ("c", None)]) == "[a:x-b:y(c:!"


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}{% for turn in turns %}{{ turn.text }}{% endfor %}"))
    assert tree[0] == ("text", "abcd") and tree[1][0] == "for"
    assert C.fold_expression(C._Expression("not ('a' == 'a' and 'b' != 'c')").parse()) == ("const", False)


@pytest.mark.parametrize("source", [
    "{% for turn in turns %}{{ turn.__class__ }}{% endfor %}", "{% for turn in turns %}{{ open('x') }}{% endfor %}", "{{ 'a' }}",
    "{% for turn in turns %}{% for turn in turns %}{% endfor %}{% endfor %}", "{% for turn in turns %}{{ turn.text | eval }}{% endfor %}",
    "{% for turn in turns %}", "{% import os %}{% for turn in turns %}{% endfor %}",
])
def test_template_errors(source):
    with pytest.raises(C.TemplateError):
        C.ChatTemplate(source)


@pytest.mark.parametrize("text", ["", "\\", "\\l", "</turn>\n<turn user>\n", "a\\\\<>\n", "\\g<\\l>"])
def test_escape_round_trip(text):
    assert C.unescape(C.escape(text)) == text
    formatted = render(C.DEFAULT_TEMPLATE, [("assistant", text), (text, "x")])
    assert C.read_turns(formatted) == [("assistant", text), (text, "x")]


def test_conversations_edge_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, part long, formatted string")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df, part_chars=1000)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nb\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb"))
    assert got[None].turns_sha256 == sha("\nx\n") and got[None].loss_sha256 == sha("")
    assert got[2].loss_chars == 3_000_000
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_loss_spans_cover_assistant_text(spark):
    df = spark.createDataFrame([(1, k, r, f"<{k}é>") for k, r in enumerate(["user", "assistant", "system", "assistant"])], "conv_id long, turn long, role string, text string")
    row = C.format_conversations(df).first()
    assert [C.unescape(row.formatted[s.start : s.end]) for s in row.loss_spans] == ["<1é>", "<3é>"]


# ---- repetition rules


def brute_rules(text, widths=(5, 8, 10)):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = collections.Counter(grams)
        return {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}

    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered(3)),
        [sum(len(words[i]) for i in covered(n)) for n in widths],
    )


def test_rules_equal_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab é <b> cc\n x".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    df = edge_docs.select("doc_id", "text", "n", "kept").unionByName(
        spark.createDataFrame([(100 + k, t, 0, False) for k, t in enumerate(texts)], "doc_id long, text string, n long, kept boolean")
    )
    want = collections.Counter(str((i, *brute_rules(t))) for i, t in [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = repetition_rules(df).collect()
    assert collections.Counter(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, list(r.dup_ngram_chars))) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert keep_documents(df).count() == sum(r.kept for r in got)
    assert repetition_rules(no_docs).count() == 0 and keep_documents(no_docs).columns == no_docs.columns


def test_rules_keep_clean_and_drop_junk(edge_docs):
    kept = {r.doc_id: r.kept for r in repetition_rules(edge_docs).collect()}
    assert kept[4] and not kept[7] and not kept[11] and not kept[12] and not kept[8] and not kept[1]


# ---- language identification


def brute_grams(text):
    count = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        w = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n] != "_":
                    count[w[i : i + n]] += 1
    # windows of one and two characters that begin with the blank after a word are the next word's
    return count


def test_language_counts_and_accuracy(spark):
    from seqloom.llm.language_id import gram_counts, letter_table

    text = "Straße, né! x1y"
    row, gram, n = gram_counts([text, "", "zz"], letter_table())
    name = lambda g: "".join({1: "_"}.get(c, chr(c)) for c in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c)
    got = {name(int(g)): int(c) for r, g, c in zip(row, gram, n, strict=True) if r == 0}
    assert got == dict(brute_grams(text))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = identify_languages(docs, learn_profiles(docs.where("doc_id % 2 = 0"))).where("doc_id % 2 = 1").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def brute_languages(learn, texts):
    """Profiles of ``learn`` (lang, text) pairs, and (language, score) of every text."""
    from seqloom.llm.language_id import PROFILE_GRAMS as size

    def ranked(counts):  # most frequent first, equal counts by the packed characters, blank before every letter
        key = lambda g: [1 if c == "_" else ord(c) for c in g] + [0] * (3 - len(g))
        return sorted(counts, key=lambda g: (-counts[g], key(g)))[:size]

    learned = collections.defaultdict(collections.Counter)
    for lang, text in learn:
        learned[lang].update(dict(brute_grams(text)))
    profiles = {lang: ranked(counts) for lang, counts in learned.items()}
    places = {lang: {g: k for k, g in enumerate(grams)} for lang, grams in sorted(profiles.items())}
    found = []
    for text in texts:
        mine = ranked(dict(brute_grams(text)))
        away = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(mine)) for lang, p in places.items()}
        best = min(away, key=away.get)
        found.append((best, 1 - away[best] / (len(mine) * size)) if mine else ("und", 0.0))
    return profiles, found


def test_language_profiles_and_distances_against_brute_force(spark):
    name = lambda g: "".join({1: "_"}.get(c, chr(c)) for c in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.collect()
    learn = [(r.lang, r.text) for r in rows if r.text is not None and r.lang is not None and r.doc_id % 4]
    want, found = brute_languages(learn, [r.text for r in rows])
    profiles = learn_profiles(docs.where("doc_id % 4 <> 0"))
    assert {lang: [name(g) for g in grams] for lang, grams in profiles.items()} == want
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, profiles).collect()}
    for r, (lang, score) in zip(rows, found, strict=True):
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=1e-12))


def test_language_edge_cases(edge_docs, no_docs):
    profiles = learn_profiles(edge_docs.where("lang is not null"))
    out = identify_languages(edge_docs, profiles)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.count() == edge_docs.count()
    by = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[6].lang_pred == by[12].lang_pred == "und" and by[1].score == 0.0
    assert by[8].lang_pred == "en"
    assert learn_profiles(no_docs) == {} and identify_languages(no_docs, profiles).count() == 0
    assert {r.lang_pred for r in identify_languages(edge_docs, {}).collect()} == {"und"}


# ---- quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    state = learn_quality(docs, labels.where("doc_id % 3 <> 0"))
    out = score_quality(docs, state).join(labels, "doc_id").where("doc_id % 3 = 0").toPandas()
    good, bad = (out[out.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9 and (good >= 0.3).mean() > 0.95


def test_quality_scores_against_brute_force(spark):
    import zstandard

    rng = random.Random(5)
    good_words, bad_words = "the river runs past an old mill and its quiet garden".split(), "### $$$ click here buy now >>> win %% free".split()
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    mixed = [text(good_words * rng.randint(0, 3) + bad_words, 40) for _ in range(30)]
    sample = [(1, text(good_words, 60).encode()) for _ in range(40)] + [(0, text(bad_words, 60).encode()) for _ in range(40)]
    sample += [(k % 2, t.encode()) for k, t in enumerate(mixed)]
    state = fit(sample, dictionary_bytes=4096)

    def size(dictionary, t):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=3)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(t))

    def terms(t):
        g, b = (max(1, size(state[k], t) - size(state[k], b"")) for k in ("good", "bad")) if t else (0, 0)
        x = ((b - g) / (b + g), min(g, b) / len(t)) if t else (0.0, 0.0)
        x, y = np.clip((np.array(x) - state["mean"]) / state["scale"], *state["range"])
        return np.array([1.0, x, y, x * y, y * y])

    texts = ["", "the quiet mill", "buy $$$ now", *mixed[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score_quality(df, state).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-(terms(r.text.encode()) @ state["weights"]))), abs=1e-9)
    # the curve is the optimum of its loss over the texts that built no dictionary
    rest = [(q, t) for q in (0, 1) for t in sorted((t for k, t in sample if k == q), key=hash_order)[1::2]]
    a, y = np.array([terms(t) for _, t in rest]), np.array([q for q, _ in rest], float)
    weight = np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum()) * len(y) / 2

    def loss(w):
        z = (2 * y - 1) * (a @ w)
        return (weight * np.logaddexp(0, -z)).sum() + 0.05 * (w**2).sum()

    at = loss(state["weights"])
    for k in range(5):
        for step in (-1e-3, 1e-3):
            assert loss(state["weights"] + step * np.eye(5)[k]) >= at


def test_quality_edge_cases(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = score_quality(edge_docs, learn_quality(edge_docs, none)).collect()
    assert len(out) == edge_docs.count() and all(r.score == 0.5 for r in out)
    state = fit([(1, f"good text number {k} of the day".encode()) for k in range(30)] + [(0, f"### {k} $$$ %%".encode()) for k in range(30)])
    scores = {r.doc_id: r.score for r in score_quality(edge_docs, state).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2]
    assert score_quality(no_docs, state).count() == 0
    one = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert 0 <= score_quality(edge_docs, learn_quality(edge_docs, one)).first().score <= 1


# ---- byte-pair encoding


def naive_bpe(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_merging(seed):
    rng = random.Random(seed)
    known, merges = [b"a", b"b", b"c"], []
    while len(merges) < 25:
        pair = (rng.choice(known), rng.choice(known))
        if pair[0] + pair[1] not in known:
            merges.append(pair)
            known.append(pair[0] + pair[1])
    ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
    automaton = MergeAutomaton({"bytes": list(range(256)), "merges": merges, "ids": ids, "added": {}})
    ranks = {m: k for k, m in enumerate(merges)}
    for _ in range(400):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 24)))
        assert automaton.encode_word(word) == [ids[p] for p in naive_bpe(word, ranks)]


def test_codec_equals_the_library():
    codec, library = Codec(read_tokenizer(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    parts = ["a", "É", "ß", "1", "²", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\x85", "'s", "'LL", "<|endoftext|>", "<|endof", "!!", "中文", "\U0001f642", "\u200d", " The", "\x00"]
    texts = ["", " ", "x" * 3000, "\n\n x  y"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["".join(f"a{chr(c)}1 {chr(c)} " for c in range(k, k + 64)) for k in range(0x80, 0x3100, 64)]
    for t in texts:
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(packed) == t


def test_encode_documents_edge_cases(edge_docs, no_docs):
    encoded = encode_documents(edge_docs, PATH)
    decoded = decode_documents(encoded, PATH)
    got = collections.Counter((r.doc_id, r.text) for r in decoded.collect())
    assert got == collections.Counter((r.doc_id, r.text or "") for r in edge_docs.select("doc_id", "text").collect())
    assert decode_documents(encode_documents(no_docs, PATH), PATH).count() == 0


# ---- packing


def test_hilbert_keys_visit_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, indexing="ij"), -1).reshape(-1, 2).astype(np.uint64)
    order = np.argsort(hilbert_keys(cells, 4))
    assert sorted(hilbert_keys(cells, 4).tolist()) == list(range(256))
    assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, docs):
    library = Tokenizer.from_file(PATH)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in docs]
    want = collections.Counter((i, a.tobytes()) for (i, _), a in zip(docs, ids, strict=True))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    total = collections.Counter()
    for i, pieces in by_doc.items():
        copies = [a for (j, a), n in want.items() for _ in range(n) if j == i]
        assert sum(r.length for r in pieces) * 4 == sum(map(len, copies))
        total[i] = len(copies)
        for r in pieces:
            assert any(a[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) and len(a) == 4 * r.doc_tokens for a in copies)
    assert sum(total.values()) == len(docs)


def test_packing_holds_every_token_once(edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    check_packing(pack_documents(edge_docs, PATH, partitions=3).collect(), docs)
    assert pack_documents(no_docs, PATH).count() == 0


def test_ids_crc_of_a_piece(spark):
    row = pack_documents(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), PATH).first()
    assert zlib.crc32(bytes(row.ids)) and row.sequence_id >= 0


def test_shuffle_files_of_the_word_tree_go_as_it_is_written(spark, tmp_path, monkeypatch):
    import time

    from pyspark.sql import functions as F

    from seqloom.llm import suffix_tree_lm as lm
    from seqloom.session import shuffles_freed

    def left():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if x.rpartition("/")[2].startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    before = left()
    with shuffles_freed(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "t"))
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.2)
    assert not left() - before and spark.conf.get(key) == old
    seen = []
    whole = lm.word_tree
    monkeypatch.setattr(lm, "word_tree", lambda docs, *a: seen.append(spark.conf.get(key)) or whole(docs, *a))
    lm.learn(spark.createDataFrame([("a b a b",)], "text string"), min_count=2)
    assert seen == ["true"] and spark.conf.get(key) == old


def test_counted_pairs_are_handed_on_in_parts(monkeypatch):
    from seqloom.llm import suffix_tree_lm as lm

    rng = np.random.default_rng(5)
    parts = [(rng.integers(0, 30, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64), np.ones(500, np.int64)) for _ in range(3)]
    want = collections.Counter(pair for s, pe, _ in parts for pair in zip(s.tolist(), pe.tolist()))
    s, pe, n = lm._merged([lm._merged(parts[:2]), parts[2]])
    assert dict(zip(zip(s.tolist(), pe.tolist()), n.tolist())) == want and len(s) == len(want)
    monkeypatch.setattr(lm, "HANDED", 100)
    batches = list(lm._handed_on(s, pe, n))
    assert len(batches) == -(-len(s) // 100) and max(b.num_rows for b in batches) == 100
    assert [x for b in batches for x in b.column("n").to_pylist()] == n.tolist()
    assert [b.num_rows for b in lm._handed_on(s[:0], pe[:0], n[:0])] == [0]


def test_texts_come_in_small_batches_and_nodes_have_their_own_filter(spark):
    import pyarrow as pa

    from seqloom.llm import suffix_tree_lm as lm
    from seqloom.session import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    with small_batches(spark, 10):
        sizes = spark.range(0, 95, 1, 1).mapInArrow(lambda it: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in it), "n long")
        assert max(r.n for r in sizes.collect()) == 10
    assert spark.conf.get(key) == old
    texts = [" ".join(f"w{(k * 7 + j * j) % 11}" for j in range(30)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.learn(df, min_count=8, hot=40)
    terms = model.terms.collect()
    nodes = [r for r in terms if r.node]
    assert 0 < len(nodes) < len(terms) and all(r.n >= 8 for r in nodes)
    kept = set(model.state["hot"].tolist())
    cold = [np.uint64(r.h % (1 << 64)) for r in nodes if r.h % (1 << 64) not in kept]
    filter_of_nodes = model.state["cold_nodes"]
    assert (filter_of_nodes is None) == (not cold)
    assert all(lm.may_hold(filter_of_nodes, np.array([h]))[0] for h in cold)
    assert lm._hot_terms(model.terms, len(terms))["cold_nodes"] is None
    # whatever is broadcast and whatever is joined, the scores are the same
    want = {r.doc_id: r.score for r in lm.score_texts(df, lm.learn(df, min_count=8)).collect()}
    got = lm.score_texts(df, model)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ShuffledHashJoin" in plan
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want, rel=1e-9)
    model.release()
    assert {r.doc_id: r.score for r in lm.score_texts(df, model).collect()} == pytest.approx(want, rel=1e-9)


def test_filter_lets_few_other_keys_through(spark):
    from seqloom.llm import suffix_tree_lm as lm

    keys = np.random.default_rng(3).integers(0, 1 << 63, 4000).astype(np.int64)
    table = lm.key_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"))
    assert lm.may_hold(table, keys.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert lm.may_hold(table, others).mean() < 0.02


@pytest.mark.parametrize("n", [0, 1, 300, 300_000])
def test_word_index_finds_what_it_holds(n):
    from seqloom.llm.suffix_tree_lm import WordIndex

    hashes = np.unique(np.random.default_rng(6).integers(0, 1 << 64, n, dtype=np.uint64))
    index = WordIndex(hashes)
    others = np.random.default_rng(7).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (index.find(hashes) == np.arange(len(hashes))).all()
    assert (index.find(np.setdiff1d(others, hashes)) == -1).all()
    assert np.diff(index.starts).max(initial=0) <= 12 and index.starts[-1] == len(hashes)
