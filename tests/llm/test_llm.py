import base64
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import pairs  # noqa: E402
from graphloom.llm.conversations import corrected_turns, rebuilt, sender_clocks, turns  # noqa: E402
from graphloom.llm.encode import PATTERN, TOKENIZERS, VOCABULARY, Encoder, Vocabulary, token_ids  # noqa: E402
from graphloom.llm.languages import label_language  # noqa: E402
from graphloom.llm.leakage import WORDS, Patterns, leaks, words  # noqa: E402
from graphloom.llm.segments import LANGUAGES, fit_profiles, language_segments, mislabelled  # noqa: E402
from graphloom.llm.text import each_sentence, is_sentence, letters, ngrams, prose, prose_words, sentences, unwrapped, without_code, without_names  # noqa: E402

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


# Encoding


@pytest.fixture(scope="module")
def encoder():
    path = Path(TOKENIZERS, VOCABULARY)
    if not path.exists():
        pytest.skip("no vocabulary")
    return Encoder(Vocabulary(path))


def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(TOKENIZERS, VOCABULARY).open("rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(encoder):
    rnd = random.Random(3)
    alphabet = "aabcdeehilnorstTHE  \n\t.,'0123é日本語🙏​<|>_-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(300)]
    texts += ["", " ", "   x", "don't we'll", "<|endoftext|>", "a" * 300, "ab" * 700, "=" * 5000, "Donaudampfschiffahrt" * 40, "\r\n\r\n  \r\n", "x" * 257]
    known = reference_encoding()
    assert encoder.encode(texts).to_pylist() == [known.encode_ordinary(t) for t in texts]


def test_long_words_equal_short_ones(encoder):
    rnd = random.Random(4)
    raw = ["".join(rnd.choice("aabent") for _ in range(rnd.randrange(2, 250))) for _ in range(200)]
    short = encoder.encode_words(raw)
    long = [encoder._long(encoder.vocabulary.bytes[np.frombuffer(w.encode(), np.uint8)]) for w in raw]
    assert all(np.array_equal(a, b) for a, b in zip(short, long))


def test_ids_table(spark, encoder):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    assert got == {1: reference_encoding().encode_ordinary("hello world"), 2: [], 3: []}
    assert token_ids(df.limit(0)).collect() == []


# Conversations


def conversation(spark, data):
    return spark.createDataFrame([(*d, "x") for d in data], "id bigint, conversation_id bigint, position int, role string, content string, created_at string, speaker string")


def test_rebuilt(spark, rows):
    t = "2025-01-01T00:00:0{}Z".format
    data = [
        (1, 1, 0, " Human ", "hi", t(5)), (2, 1, 1, "BOT", "yo", t(1)), (9, 1, 1, "bot", "yo \n", t(1)), (9, 1, 1, "bot", "yo \n", t(1)),
        (3, 2, 0, "user", "hi", t(1)), (4, 2, 2, "assistant", "gap", t(2)),
        (5, 3, 0, "user", "hi", t(1)), (6, 3, 1, "assistant", "​  ", t(2)),
        (7, 4, 0, "user", "hi", t(1)), (8, 4, 1, "tool-??", "x", t(2)),
        (10, 5, 0, "user", "hi", t(1)), (11, 5, 1, "assistant", "a", t(2)), (12, 5, 1, "assistant", "b", t(2)),
        (13, 6, 0, "user", "hi", t(1)), (14, 6, 1, "user", "again", t(2)), (15, 6, 2, "assistant", "x", t(2)),
        (16, 7, 0, "sys", "s", t(1)), (17, 7, 1, "user", "q", t(1)), (18, 7, 2, "system", "s", t(1)), (19, 7, 3, "ai", "a", None),
        (20, 8, 0, "user", "only", t(1)), (21, None, 0, "user", "x", t(1)), (22, 9, None, "user", "x", t(1)), (23, 9, 0, "user", "x", t(1)), (24, 9, 1, "ai", "x", t(1)),
        (25, 10, -1, "user", "x", t(1)), (26, 10, 0, "ai", "x", t(1)), (27, 11, 0, "system", "x", t(1)), (28, 12, 0, "user", None, t(1)), (29, 12, 1, "ai", "x", t(1)),
    ]
    got = rebuilt(conversation(spark, data))
    assert rows(got) == sorted([(1, 0, 1, "user"), (1, 1, 2, "assistant"), (7, 0, 16, "system"), (7, 1, 17, "user"), (7, 2, 18, "system"), (7, 3, 19, "assistant")], key=repr)
    assert rows(rebuilt(conversation(spark, []))) == []


def test_conversations_longer_than_a_block(spark):
    def long(c, n, broken=None):
        return [(c * 10_000 + k, c, k, ("user", "assistant")[(k + (broken is not None and k >= broken)) % 2], f"m{k}", None) for k in range(n)]

    data = long(1, 3000) + long(2, 3000, 1024) + long(3, 2999) + long(4, 2048)
    kept = rebuilt(conversation(spark, data)).groupBy("conversation_id").count().collect()
    assert sorted(tuple(r) for r in kept) == [(1, 3000), (4, 2048)]


def test_clock_offsets(spark):
    base = "2025-01-01T00:{:02}:00Z".format
    # the assistant's clock is 20 minutes behind; each reply takes 2 minutes
    data = [(k, 1, k, ("user", "assistant")[k % 2], "x", base(30 + 2 * k - (20 if k % 2 else 0))) for k in range(6)]
    data += [(20, 2, 0, "user", "x", base(9)), (21, 2, 1, "ai", "y", base(5)), (22, 2, 2, "user", "z", base(6))]
    got = {r[0]: r for r in sender_clocks(turns(conversation(spark, data))).collect()}
    assert round(got[1]["assistant_s"]) == -20 * 60 and got[1]["feasible"] and got[1]["system_s"] == 0
    assert not got[2]["feasible"]


def test_merged_times_alone_give_the_order(spark):
    same = "2025-01-01T00:00:09Z"
    times = {1: [same] * 4, 2: [None, None, same, None], 3: [None] * 4, 4: [same, "2025-01-01T00:00:01Z", None, "2025-01-01T00:00:02Z"]}
    data = [(c * 10 + k, c, k, ("user", "assistant")[k % 2], f"m{k}", at) for c, all_ in times.items() for k, at in enumerate(all_)]
    got = corrected_turns(conversation(spark, data)).collect()
    for c in times:
        by_time = sorted((r["merged_us"], r["position"], r["place"]) for r in got if r["conversation_id"] == c)
        assert len({t for t, *_ in by_time}) == 4 and [r[1:] for r in by_time] == [(k, k) for k in range(4)]
    assert all(r["merged_us"] >= r["at_us"] for r in got if r["at_us"] is not None)
    long = [(k, 1, k, ("user", "assistant")[k % 2], f"m{k}", same if k % 700 else None) for k in range(3000)]
    merged = {r["position"]: (r["merged_us"], r["place"]) for r in corrected_turns(conversation(spark, long)).collect()}
    assert all(merged[k][0] < merged[k + 1][0] and merged[k][1] == k for k in range(2999))


# Leaks


def brute(docs, items, size):
    found = set()
    for item, text in items:
        own = words(text or "")
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for doc, body in docs:
            said = words(body or "")
            if any(tuple(said[k : k + size]) in windows for k in range(len(said) - size + 1)):
                found.add((doc, item))
    return found


def test_search_against_brute_force(spark):
    rnd = random.Random(7)
    bag = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rnd.choice(bag) for _ in range(rnd.randrange(40)))) for k in range(30)] + [(90, None), (91, ""), (92, "w0 " * 60)]
    docs = []
    for k in range(200):
        body = [rnd.choice([*bag, "other", "x"]) for _ in range(rnd.randrange(60))]
        own = (items[rnd.randrange(30)][1]).split()
        a = rnd.randrange(len(own) + 1)
        body[rnd.randrange(len(body) + 1) : 0] = own[a : a + rnd.randrange(3, 12)]
        docs.append((k, " ".join(body)))
    docs += [(900, "w0 " * 2000), (901, None), (902, "")]
    for size in (4, 7):
        text, item = Patterns(items, size).search([words(t or "") for _, t in docs])
        assert {(docs[t][0], i) for t, i in zip(text.tolist(), item.tolist())} == brute(docs, items, size)
    one = spark.createDataFrame(docs, "doc_id bigint, text string")
    two = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaks(one, two, 7, items_per_pass=9).collect()} == brute(docs, items, 7)
    assert leaks(one, two.limit(0), 7).collect() == [] and leaks(one.limit(0), two, 7).collect() == []


def test_spellings_make_no_difference():
    item = " ".join(f"Wort{'abcdefghijklmnopqrs'[k]}" for k in range(16)) + "é"
    variants = [item.upper(), item.replace(" ", "\r\n> "), item.replace(" ", " **x** ").replace("**x**", "<br/>"), "​".join(item), item.replace("é", "é"), item.replace("Wortb", "_Wortb_,"), item.replace("Wortc", "Wo­rtc"), item.replace("Wortc", "Wor-\n> tc"), item.replace("W", "Ｗ")]
    found = Patterns([(1, item)], 15).search([words(v) for v in [*variants, item.replace("Worth", "other")]])[0]
    assert set(found.tolist()) == set(range(len(variants)))
    assert WORDS == 15


# Languages


@pytest.fixture(scope="module")
def profiles(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    return fit_profiles(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_labels(spark):
    data = [("en", "en"), ("EN", "en"), ("en_GB", "en"), ("pt-BR", "pt"), ("Deutsch", "de"), ("jpn", "ja"), ("español", "es"), ("und", None), ("", None), (None, None), ("xx", None), ("english text", None)]
    df = spark.createDataFrame(data, "lang string, want string").withColumn("got", label_language(__import__("pyspark.sql.functions", fromlist=["col"]).col("lang")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_segments(spark, rows, profiles):
    en = "The parser was moved to the other package because two teams had kept separate copies."
    de = "Diese Seite beschreibt, warum die Regel nicht außerhalb der Anwendung sichtbar ist."
    ja = "この規則は別の場所に移されました。そのため、確認が必要です。"
    code = "```\npublic final class X {\n}\n```"
    data = [
        (1, f"{en} {en}", "en"), (2, f"{en}\n\n{code}\n\n{de} {de}\n# MetricBridge\n- a.b.C\n", "en"), (3, de, "en"), (4, code, "en"), (5, None, "en"), (6, " \n", None),
        (7, f'{en} ("mise en place")', "English"), (8, f"{ja}{en}", None), (9, "def f(rows):\n    return [r for r in rows if r.x]", "fr"),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = language_segments(df, profiles).select("doc_id", "segment", "lang")
    assert rows(got) == [(1, 0, "en"), (2, 0, "en"), (2, 1, "de"), (3, 0, "de"), (7, 0, "en"), (8, 0, "ja"), (8, 1, "en")]


@needs_data
def test_labels_agree_with_profiles(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r["doc_id"] for r in mislabelled(documents).collect()}
    plain = [r for r in documents.collect() if r["lang"] in LANGUAGES and r["text"] and len(r["text"]) > 200]
    assert sum(r["doc_id"] not in found for r in plain) > 0.85 * len(plain)


def test_text_helpers():
    assert prose("The `x` Foo.bar MetricBridge said 3 things") == "the x said things"
    assert without_code("a\r\n```\ncode\n```\nb").split() == ["a", "b"]
    assert sentences("One two. Three!\nfour。five") == ["One two.", "Three!", "four。", "five"]
    assert unwrapped("one\n  two,\nthree.\nfour\n\nfive\nSix") == "one two, three.\nfour\n\nfive\nSix"
    assert not is_sentence('("work in progress")') and is_sentence("Done.")
    gram, owner = ngrams(["ab", "", "ab"], (1, 2))
    assert sorted(owner.tolist()) == [0] * 5 + [2] * 5 and sorted(gram[owner == 0].tolist()) == sorted(gram[owner == 2].tolist())
    assert len(ngrams(["a b"], (3,))[0]) == 2 and len(ngrams([], (1,))[0]) == 0 and len(ngrams(["", ""], (1, 2, 3))[0]) == 0


# Pairs


@pytest.fixture(scope="module")
def models(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    asks, documents = spark.read.parquet(f"{DATA}/ask_log.parquet"), spark.read.parquet(f"{DATA}/documents.parquet")
    answering = pairs.fit_answers(documents)
    return pairs.fit_ends(asks, documents), pairs.fit_questions(asks, answering), answering


EN = "The scheduler was moved to the other package because two teams had kept separate copies."


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Why?", None, "empty"), ("Why?", " ​\n", "empty"), ("Why?", "N/A", "empty"), ("Why?", "<answer></answer>", "empty"), ("Why?", "```\n```", "empty"), ("Why?", "—", "empty"),
        ("Where is TokenLoader created within pine-store?", "where is tokenloader created within pine-store", "copy"),
        ("Where is TokenLoader created within pine-store?", "You asked: Where is TokenLoader created within pine-store?", "copy"),
        ("Where is TokenLoader created within pine-store?", f"> Where is TokenLoader created within pine-store?\n\n{EN}", None),
        ("Where is TokenLoader created?", "`lint.rules`", None),
        ("Why is that so?", "I'm sorry, but I can't help with that request.", "refusal"), ("Warum ist das so?", "Dazu möchte ich keine Auskunft geben. 🙏", "refusal"),
        ("Why is that so?", "Why is that so?\nUnfortunately this is not something I can assist with.", "refusal"),
        ("Why is that so?", f"I'm not able to run the code; still, the graph answers this. {EN}", None),
        ("Why is that so?", EN[:40], "truncated"), ("Why is that so?", f"{EN}\n\n```\nx = 1", "truncated"), ("Why is that so?", f"{EN}\n\n```\nx = 1\n```", None),
        ("Why is that so?", f"{EN} They are:\n- owner.map.RouteResolver\n- diff.lines.BatchGuard", None), ("Why is that so?", f"{EN} They are:\n- owner.map.RouteResolver\n- ", "truncated"),
        ("Which types in north-engine depend on the cache and who owns them?", "Ce qui nous a surpris, c'est que la vérification utilise si peu le cache du module.", "language"),
        ("Which types depend on the cache? Answer in French, please.", "Ce qui nous a surpris, c'est que la vérification utilise si peu le cache du module.", None),
        (None, EN, None), ("Is it allowed?", "No.", None), ("Which kind is it?", "Available", None),
        ("Which port?", "I must decline the default and use 8080 here.", None), ("Welcher Port?", "Ich kann das nicht empfehlen, weil Port 8080 belegt ist.", None), ("Quale porta?", "Non posso confermare che la porta sia 8080.", None),
        ("May we rename it?", "I can't recommend that because the migration still runs.", None), ("Why is that so?", f"{EN} They are:\n1.", "truncated"), ("Why is that so?", f"{EN} This page explains …", "truncated"),
        ("Why is that so?", " ".join(["why is that so"] * 12), "copy"),
    ],
)
def test_defects(models, question, answer, defect):
    assert pairs.find_defects([question], [answer], *models) == [defect]


def test_the_likelihood_decides_truncation(models):
    ends = models[0]
    cut = [EN[:k] for k in range(30, len(EN) - 12, 7)]
    assert pairs.are_truncated(cut, ends).mean() > 0.9 and not pairs.are_truncated([EN, f"{EN} {EN}"], ends).any()
    nothing = pairs.Ends(*(np.zeros(0, np.int64) for _ in range(4)))
    assert not pairs.are_truncated(cut, nothing).any()


def test_pairs_table(spark, rows):
    asks = spark.createDataFrame([(1, None, "Q?", ""), (1, None, "Q?", ""), (2, 10, "Q?", None), (3, 11, "Q?", None), (4, 12, "Q?", " "), (5, 13, "Q?", "")], "ask_id bigint, turn_id bigint, question string, answer string")
    turn = spark.createDataFrame([(10, "failed", "2025-01-01T00:00:00Z"), (10, "completed", "2025-01-02T00:00:00Z"), (11, "running", "2025-01-01T00:00:00Z"), (12, "completed", "2025-01-01T00:00:00Z")], "id bigint, status string, updated_at string")
    documents = spark.createDataFrame([(1, EN, "en")], "doc_id bigint, text string, lang string")
    assert rows(pairs.defective_pairs(asks, turn, documents)) == [(1, "empty"), (2, "empty"), (4, "empty"), (5, "empty")]
    assert rows(pairs.defective_pairs(asks.limit(0), turn.limit(0), documents.limit(0))) == []


def test_naive_bayes_accuracy(models):
    held = {"en": "This page explains why nothing else depends on it.", "de": "Niemand sollte das direkt aufrufen, solange es umgebaut wird.", "fr": "Merci de ne pas renommer cela avant la fin de la migration.", "es": "Nadie debería llamar directamente mientras siga cambiando."}
    likely = models[2].posteriors([prose(t) for t in held.values()])
    assert [LANGUAGES[k] for k in likely.argmax(axis=1)] == list(held)
    assert not re.search("nan", str(likely))


def test_pair_models_count_every_row(spark):
    documents = spark.range(1500).selectExpr("id AS doc_id", f"'{EN}' AS text", "if(id < 1400, 'en', null) AS lang")
    ends = pairs.fit_ends(spark.createDataFrame([], "answer string"), documents)
    assert ends.levels[0][1].sum() == 1500
    answering = pairs.fit_answers(documents)
    assert answering.counts.max() % 1400 == 0
    asks = spark.range(21000).selectExpr("id AS ask_id", "'Why zzzz?' AS question", f"'{EN}' AS answer")
    assert (pairs.fit_questions(asks, answering).counts - answering.counts).max() % 21000 == 0


ODD = [
    "The `x` Foo.bar MetricBridge said 3 things. The end!\tIt's İstanbul, ΟΔΟΣ ΟΔΟΣ.a x²y\u00a0z\x85w", "日本語です。つぎ！ one\u3000two…) three", "", " \n ", "a" * 50 + ".b", "e\u0301 a\u00adb", "im Jahr 2024,das/ist x_y __init__ a-b c--d 4.5.6",
    "x = 1;\nSay it; then go\n  return y\n}\n if (a)\n\"k\" : 1\nreturned\nend {  \n\n[1]\rimport os\r\nlast",
]


def test_words_are_counted_as_in_sentences():
    texts = [without_code(t) for t in ODD]
    assert texts[-1] == "\n".join([" ", "Say it; then go", " ", " ", " ", " ", "returned", " ", "", " ", " ", "last"])
    pieces = [letters(s) for t in texts for s in sentences(without_names(t))]
    assert prose_words(texts) == Counter(w for p in pieces for w in p.split())
    assert [prose(t).split() for t in texts] == [letters(without_names(t)).split() for t in texts]
    assert [list(each_sentence(t)) for t in ODD] == [sentences(t) for t in ODD]
    gram, _ = ngrams(pieces * 3, pairs.SIZES)
    wanted = np.bincount((gram % np.uint64(pairs.BUCKETS)).astype(np.int64), minlength=pairs.BUCKETS)
    found = next(pairs._task_counts(iter([("en", prose_words(texts)), ("en", prose_words(texts * 2))])))
    assert found["gram"].tolist() == np.flatnonzero(wanted).tolist() and found["n"].tolist() == wanted[wanted > 0].tolist()


def test_the_words_of_many_texts_are_scored_once(monkeypatch):
    model, seen = pairs.NaiveBayes(np.random.default_rng(1).integers(0, 9, (pairs.BUCKETS, len(LANGUAGES)))), []
    one = model.posteriors([prose(EN), "", "zz"])
    monkeypatch.setattr(pairs, "ngrams", lambda texts, sizes: seen.extend(texts) or ngrams(texts, sizes))
    assert np.array_equal(model.posteriors([prose(EN), "", "zz"] * 1000), np.tile(one, (1000, 1)))
    assert sorted(seen) == sorted({*prose(EN).split(), "zz"})
    gram, _ = ngrams([prose(EN)], pairs.SIZES)
    score = model.weights[(gram % np.uint64(pairs.BUCKETS)).astype(np.int64)].sum(axis=0, dtype=np.float64)
    assert np.allclose(one[0], np.exp(score - score.max()) / np.exp(score - score.max()).sum())


def plain_contexts(text):
    """Of each character: the buckets of its contexts, and whether names may stand there."""
    kinds = [97 if 97 <= c <= 122 or 0xC0 <= c < 0x2000 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 0x3040 if 0x3040 <= c < 0xA000 else c for c in map(ord, text)]
    classes = [49 if kinds[max(k - 2, 0) : k + 1] == [48] * 3 else c for k, c in enumerate(kinds)]
    lower = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
    for k in range(len(text)):
        head = text.rfind("\n", 0, k) + 1
        line = text[head : k + 1]
        fences = sum(text[j - 2 : j + 1] == "```" and text[j - 3 : j - 2] != "`" for j in range(2, k + 1))
        listed, bare = text[head] in "-*+•" and text[head + 1 : head + 2] == " " and k > head + 1, not re.search("[ \n]", text[: k + 1])
        state = fences % 2 | listed << 1 | line.count("`") % 2 << 2 | line.count('"') % 2 << 3 | (line.count("(") > line.count(")")) << 4 | bare << 5
        buckets = []
        for symbols, sizes, size in ((classes, pairs.END_CLASSES, pairs.CLASS_BUCKETS), (lower, (pairs.END_CHARS,), pairs.END_BUCKETS)):
            for n in sizes:
                mixed = state + 1
                for j in range(n):
                    mixed = (mixed * 0x9E3779B97F4A7C15 + (symbols[k - j] if j <= k else 0)) % 2**64
                buckets.append(((mixed ^ mixed >> 31) * 0xBF58476D1CE4E5B9 % 2**64 >> 32) % size)
        yield buckets, k + 1 == len(text), bool(listed or line.count("`") % 2 or bare)


def test_contexts_are_those_of_each_text():
    draw = random.Random(4)
    texts = ["```a\n```\n\n- b (c\n* d) 1234", "-", "- ", "````x", "``", "A1b22C333", "\n", '"\n"', "\U0001f600é日ア"]
    texts += ["".join(draw.choice('aBé012 \n``"()-•*+日') for _ in range(draw.randint(1, 40))) for _ in range(150)]
    plain = [list(plain_contexts(t)) for t in texts]
    for last_only in (False, True):
        contexts, end, named = pairs._end_contexts(texts, last_only)
        found = [(list(b), e, n) for *b, e, n in zip(*(x.tolist() for x in (*contexts, end, named)))]
        assert found == [x for own in plain for x in (own[-1:] if last_only else own)]
