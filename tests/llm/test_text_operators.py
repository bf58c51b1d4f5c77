"""Token counts, SentencePiece, personal data and line templates against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from loregrid.llm import line_templates, pii, sentence_pieces, token_counts
from loregrid.llm.arrays import plain, sliced
from loregrid.llm.queries import tokenizer_path

MIXED = ["a", "b", "'s", "'", "'re", "'ll", "s", " ", "  ", "\n", "\t", "12", "!", "é", "ß", "日本", "x'd", "<|endoftext|>", "<|", "²", "🙂", "▁", "<0x0A>", "th", "er", "ing", "\x85"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(MIXED, k=rng.randint(0, 14))) for _ in range(n)] + ["", "a" * 3000, "ab" * 2000, " " * 300, "\n" * 50, "'" * 99]


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = mixed(3000, 1)
    got = token_counts.Counter(token_counts.load_vocabulary(path)).of(pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_counts_as_in_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = [f"a{c}a1{c}1 {c} !{c}!" for c in map(chr, [*range(0x3000), *range(0xFE00, 0x10100), *range(0x1F300, 0x1F700)]) if not 0xD800 <= ord(c) < 0xE000]
    got = token_counts.Counter(token_counts.load_vocabulary(path)).of(pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_count_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "one two", 9), (3, "one two", 9), (4, "x " * 600, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out[:4]] == [(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (3, 7, 2, False)]
    assert out[4].over_limit
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_pieces_are_the_librarys():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder, texts = sentence_pieces.Encoder(sentence_pieces.load_model(path)), mixed(2000, 2)
    got, back = [], []
    for i, j, data, offsets in sliced(plain(pa.array(texts))):
        pieces, at = encoder.encode(data, offsets)
        out, to = encoder.decode(pieces, at)
        got += [pieces[at[k] : at[k + 1]].tolist() for k in range(j - i)]
        back += [out[to[k] : to[k + 1]].tobytes().decode() for k in range(j - i)]
    assert got == sp.encode(texts)
    assert back == sp.decode(got)


def test_viterbi_finds_the_best_path():
    model = sentence_pieces.load_model(tokenizer_path("piece_bpe_32k.model")) | {"bpe": False}
    score = dict(zip(model["id"].tolist(), model["score"].tolist(), strict=True))
    encoder = sentence_pieces.Encoder(model)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for text in ("there", "inner thing", "unbelievable", "ab ab"):
        data, offsets = next((d, o) for _, _, d, o in sliced(plain(pa.array([text]))))
        pieces, _ = encoder.encode(data, offsets)
        whole = "▁" + text.replace(" ", "▁")
        best = {0: 0.0}
        for b in range(1, len(whole) + 1):
            best[b] = max((best[a] + score[sp.piece_to_id(whole[a:b])] for a in range(max(0, b - 16), b) if sp.piece_to_id(whole[a:b]) in score and a in best), default=float("-inf"))
        assert sum(score[p] for p in pieces.tolist()) == pytest.approx(best[len(whole)])


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x")], "doc_id long, text string, pieces string")
    path = tokenizer_path("piece_bpe_32k.model")
    coded = sentence_pieces.encode(docs, path)
    out = sentence_pieces.decode(coded, path).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "Hello  world\n", "Hello  world\n"]
    assert [r.n_pieces for r in out[:2]] == [0, 0] and all(r.round_trip for r in out)
    assert sentence_pieces.encode(docs.limit(0), path).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


PII = ["a@b.c@d.e", "a@b.c_x@d.e x@y", "1.2.3.4.5.6.7.8 1.2.3.256 000001.2.3.4", "+1 (988) 555-2485. 4111 1111 1111 1111 4111-1111-1111-1112", None, "", "é@x.de ü a.b+c@x-y.co.uk...", "+1+12345678901 + 1"]
PII += ["1" * 20000, "a" * 60000, "1 " * 5000 + "2", "+1" + " " * 20000, ("x" * 50 + "@") * 300, "1." * 5000, "😀 a@b.cc 😀 4012888888881881", "mail joe [at] mail (dot) com, call (202) 555-0143"]


def test_base_spans_are_exact_and_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PII)], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        base = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in base.split(",")) for k in BASE]
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_pii_of_an_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expectation_maximisation_trusts_agreeing_labelers():
    post = pii.expectation_maximisation({(0, (1, 1, 1)): 90, (0, (1, 1, 0)): 60, (0, (-1, -1, 0)): 80, (0, (0, -1, -1)): 30, (0, (0, 1, 1)): 10})
    assert post[0, (1, 1, 1)] > 0.95 and post[0, (-1, -1, 0)] < 0.05 and post[0, (0, 1, 1)] > 0.5


def masked(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]


def deduplicated(rows):
    """{id: text} by a plain version of the template tree."""
    leaves = defaultdict(lambda: defaultdict(list))
    for d, text in rows:
        for line in (text or "").split("\n"):
            if m := masked(line):
                leaves[len(m), tuple(m[:3])][" ".join(m)].append((d, text))
    digest = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    owner = {}
    for leaf, forms in leaves.items():
        n = leaf[0]
        docs = {f: len({t for _, t in where}) for f, where in forms.items()}
        known, template = [], {}
        for f in sorted(forms, key=lambda f: (docs[f], digest(f)), reverse=True):
            same = lambda g, f=f: sum(a == b for a, b in zip(g.split(" "), f.split(" "), strict=True)) * 4 >= 3 * len(f.split(" "))
            template[f] = next((g for g in known if same(g)), f) if n >= 5 else f
            if template[f] == f:
                known.append(f)
        total = Counter()
        for f in forms:
            total[template[f]] += docs[f]
        for f in forms:
            if total[template[f]] >= (10 if n < 8 else 2 if n >= 50 else 3):
                owner[leaf, f] = min(min(forms[g]) for g in forms if template[g] == template[f])[1]
    key = lambda line: ((len(masked(line)), tuple(masked(line)[:3])), " ".join(masked(line)))
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if owner.get(key(x), t) == t) for d, t in rows}


def test_line_templates_match_the_plain_version(spark, sf_dir):
    own = [None, "", "\n\n", "a b c d e f g 1 h i\nx", "a b c d e f g 22 h i\ny", "a b c d e f g 3x h i", "p q r s t u v w\n" * 40, " p  q r s t\tu v w", "p q r s t u v w\nz", "w" * 50000]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t, 0) for i, t in enumerate(own)], "doc_id long, text string, n_chars long"))
    out = line_templates.drop_recurring(docs).collect()
    assert {r.doc_id: r.text for r in out} == deduplicated([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out)


def test_copies_alone_make_no_template_and_repeats_stay(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine") for i in (1, 1, 2, 3, 4)], "doc_id long, text string")
    assert [r.n_dropped for r in line_templates.drop_recurring(docs).collect()] == [0] * 5
    assert line_templates.drop_recurring(docs.limit(0)).count() == 0


def kept_lines(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring(docs, **how).collect()}


def test_a_leaf_has_several_templates_by_token(spark):
    first = [f"the quick brown {w} jumps over one lazy dog today" for w in ("fox", "cat", "hen", "cow")]
    second = [f"the quick brown paper says nothing about {w} at all" for w in ("rain", "snow", "wind", "hail")]
    other = "the quick brown words of some quite different kind here"  # in two texts: the leaf's commonest form
    # Three of ninety words vary, in three of the eight runs.
    base = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    wide = [" ".join(f"{w}{chr(97 + k)}" if i in (20, 50, 80) else w for i, w in enumerate(base)) for k in range(4)]
    texts = [*first, *second, other, f"{other}\nz", *wide]
    got = kept_lines(spark, texts)
    assert [got[i] for i in range(len(texts))] == [first[0], "", "", "", second[0], "", "", "", other, f"{other}\nz", wide[0], "", "", ""]


def test_folds_equal_the_plain_first_fit(spark):
    rng = random.Random(11)
    texts = ["a b c " + " ".join(rng.choices("pqr", k=9)) for _ in range(300)]
    docs, where = Counter(set(texts)), {}
    for i, t in enumerate(texts):
        where.setdefault(t, i)
    digest = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    groups = []
    for t in sorted(docs, key=lambda t: (docs[t], digest(t)), reverse=True):
        for g in groups:
            if sum(a == b for a, b in zip(g[0].split(), t.split(), strict=True)) * 100 >= 75 * 12:
                g.append(t)
                break
        else:
            groups.append([t])
    assert len(groups) > 10
    owner = {t: min(g, key=where.get) if len(g) >= 3 else t for g in groups for t in g}
    for block in (256, 7):  # one block of forms, and several rounds
        assert kept_lines(spark, texts, block=block) == {i: t if owner[t] == t else "" for i, t in enumerate(texts)}


def test_variable_fields_of_two_templates_and_of_short_lines(spark):
    word = lambda i: "".join(chr(97 + (i // 26**j) % 26) for j in range(3))
    first = [f"user alpha logs {word(i)} in from the usual place at noon again" for i in range(6)]
    second = [f"user alpha logs out {word(i)} and leaves no note for his friends" for i in range(5)]
    short = [f"user alpha said {word(i)} yesterday" for i in range(17)]
    texts = [*first, *second, *short]
    got = kept_lines(spark, texts)
    assert [i for i, t in got.items() if t] == [0, 6, 11]


def test_many_recurring_lines_in_a_text_take_linear_time(spark):
    import time

    lines = [f"row {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long list" for i in range(8000)]
    lines = [f"{x} {y}" for x, y in zip(lines, lines[1:] + lines[:1], strict=True)]
    docs = spark.createDataFrame([(i, "\n".join([*lines, f"own {i}"])) for i in range(4)], "doc_id long, text string")
    line_templates.drop_recurring(docs).count()
    begin = time.time()
    out = {r.doc_id: r for r in line_templates.drop_recurring(docs).collect()}
    took = time.time() - begin
    assert [out[i].n_dropped for i in range(4)] == [0, 8000, 8000, 8000] and out[3].text == "own 3" and took < 30


def test_many_spans_in_a_text_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "10.0.0.1 " * 16000)], "doc_id long, text string")
    pii.report(docs.limit(1).withColumn("text", pii.F.lit("10.0.0.1"))).collect()
    begin = time.time()
    r = pii.report(docs).first()
    assert (r.n_ip, r.spans.count(",")) == (16000, 15999) and r.spans.endswith("ip:143991:143999") and time.time() - begin < 20


def test_long_lines_recur_from_two_texts(spark):
    long, usual = " ".join(f"w{chr(97 + i % 26)}" for i in range(50)), "one two three four five six seven eight nine"
    texts = [f"{long}\n{usual}\nx", f"{long}\n{usual}\ny"]
    assert kept_lines(spark, texts) == {0: texts[0], 1: f"{usual}\ny"}


def test_lines_are_made_once_and_the_last_plan_is_small(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {w}\nown {w} {i}") for i, w in enumerate("abcd")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # One pattern for blanks and one for figures: a filter on a made line made it again.
    assert plan(line_templates.parsed(docs, "doc_id", "text")).count("regexp_replace(") == 2
    out = line_templates.drop_recurring(docs)
    # What makes the recurring lines is no part of the last plan, where it stood once for each of its three uses.
    assert plan(out).count("Aggregate [") <= 2 and "Union" in plan(out)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
