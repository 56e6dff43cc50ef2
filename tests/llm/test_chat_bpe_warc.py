"""Quotation linking, byte-level BPE and WARC fixity."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gable.llm.byte_bpe import decoded, digests, encoded, read_ranks
from gable.llm.quotation import as_mail, chat_lines, linked, passages
from gable.llm.warc_fixity import archived, audited, index_of, levels_for, measured, parse, placed, read_warc, tree

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_passages():
    own, quoted = passages("Hi\nOn Monday x wrote:\n> one\n>> two\n> > two b\n> three\n\nmine\n")
    assert own == "Hi\n\nmine" and quoted == [(1, "one"), (2, "two\ntwo b"), (1, "three")]
    assert passages(None) == ("", []) and passages(">") == ("", [(1, "")])


MAILS = [
    (1, 0, "user", "How  are\nyou?"),
    (1, 1, "assistant", "> how are you?\nFine."),
    (1, 2, "user", ">> How are you?\n> Fine.\nGood."),
    (1, 3, "user", "> never said\nOdd."),
    (2, 0, "user", "How are you?"),
    (2, 1, None, "> HOW ARE YOU?\nWell."),
    (3, 5, "user", "> Well.\nWho is well?"),
    (4, 0, "user", None),
    (4, 1, "user", "> \n"),
    (5, 0, "user", "> I quote myself\nI quote myself"),
    (None, 1, "user", "> Fine.\nLost."),
    (6, None, "user", "> Fine.\nLost."),
    (7, 0, "user", "twice"),
    (7, 0, "user", "twice"),
]


def test_linked(spark):
    df = spark.createDataFrame(MAILS, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in linked(df).collect()}
    to = {k: (r.reply_thread, r.reply_order) for k, r in got.items()}
    assert linked(df).count() == len(MAILS)
    assert to[1, 1] == (1, 0) and to[1, 2] == (1, 1) and to[1, 3] == (None, None)
    assert to[2, 1] == (2, 0), "the own thread comes first"
    assert to[3, 5] == (2, 1) and got[3, 5].conversation_id == got[2, 0].conversation_id == 2
    assert to[5, 0] == to[4, 1] == (None, None) and to[None, 1] == (None, None)
    assert got[1, 2].n_quotes == got[1, 2].n_linked == 2 and got[1, 3].n_linked == 0
    assert got[1, 1].text == "Fine." and got[4, 0].text == ""
    assert {r.chat for r in chat_lines(linked(df)).where("conv_id = 2 and turn = 1").collect()} == {"<|unknown|>\nWell.\n<|end|>\n"}
    assert linked(df.limit(0)).count() == 0


def reading(rows):
    return [(r.conv_id, r.turn) for r in sorted(rows, key=lambda r: (r.conversation_id, r.thread_rank, r.conv_id, r.turn))]


def test_answers_follow_what_they_answer(spark):
    mails = [(5, 0, "u", "First words"), (3, 0, "u", "> First words\nmine"), (1, 0, "u", "> mine\nlast"), (9, 0, "u", "alone")]
    rows = linked(spark.createDataFrame(mails, "conv_id long, turn long, role string, text string")).collect()
    assert reading(rows) == [(5, 0), (3, 0), (1, 0), (9, 0)] and {r.conversation_id for r in rows} == {1, 9}
    circle = [(1, 0, "u", "one"), (2, 0, "u", "two"), (1, 1, "u", "> two\nx"), (2, 1, "u", "> one\ny")]
    rows = linked(spark.createDataFrame(circle, "conv_id long, turn long, role string, text string")).collect()
    assert reading(rows) == [(1, 0), (1, 1), (2, 0), (2, 1)] and {r.conversation_id for r in rows} == {1}


def test_parts_of_messages(spark):
    """Trimmed quotations and answers between the lines; a passage goes to the message that most of it agrees on."""
    mails = [
        (1, 0, "u", "Can you come?\nWe eat at eight.\nBring wine."),
        (1, 1, "a", "We eat at eight.\nSo do we."),
        (1, 2, "u", "> Can you come?\nYes.\n> We eat at eight.\n> Bring wine.\nRed?"),
        (1, 3, "a", "> Bring wine.\nWhite."),
        (1, 4, "a", "> Nobody\n> said this\nWhite."),
        (2, 0, "u", "> Can you come?\n> We eat at eight.\nWho?"),
    ]
    got = {(r.conv_id, r.turn): r for r in linked(spark.createDataFrame(mails, "conv_id long, turn long, role string, text string")).collect()}
    to = {k: (r.reply_thread, r.reply_order, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert to[1, 2][2:] == (2, 2) and to[1, 2][0] == 1 and got[1, 2].text == "Yes.\nRed?"
    assert to[1, 3] == (1, 0, 1, 1) and to[1, 4] == (None, None, 1, 0) and to[2, 0] == (1, 0, 1, 1)


def test_one_line_for_ever(spark):
    """A thread that says and quotes one line over many stretches of orders."""
    rows = [(1, k, "u", "> again\nagain" if k % 2 else "again") for k in range(3000)]
    got = linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3000 and all(r.reply_order == (r.turn - 1 if r.turn % 2 else None) for r in got)


def test_repeated_rows_of_one_order(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "> a\nx"), (1, 1, "u", "> a\nx"), (1, 1, "u", "y"), (1, None, "u", "> a"), (None, 1, "u", None)]
    got = linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.text, r.n_quotes, r.n_linked) for r in got) == [("", 0, 0), ("", 1, 0), ("a", 0, 0), ("x", 1, 1), ("x", 1, 1), ("y", 0, 0)]
    assert as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 6


def test_mail_and_back(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    text = {(r.conv_id, r.turn): r.text for r in df.collect()}
    back = linked(as_mail(df)).collect()
    assert len(back) == len(text)
    for r in back:
        assert r.text == text[r.conv_id, r.turn].strip()
        assert r.reply_order == (r.turn - 1 if r.turn else None)


@pytest.fixture(scope="module")
def enc():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


ODD = [None, "", " ", "\n\n  a", "a<|endoftext|>b", "don't I'LL 've", "ünïcødé 漢字 😀👍🏽", "12 345,6 x²", "\x1c\x85\xa0  a​", "x" * 300, "a b " * 5000, "tab\tend  \r\n ", "aaaaaaa", "\x00a", "a" * 9000 + "b", "the" * 700, "".join(random.Random(5).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=100_000))]


def test_bpe(spark, sf, enc, monkeypatch):
    import gable.llm.byte_bpe as m

    monkeypatch.setattr(m, "WORDS", 200)  # most words are folded where they stand
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([32, 97, 101, 116, 233, 0x4E2D, 10, 39])) for _ in range(40)) for _ in range(40)]
    docs = real.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD + noise + noise[:5])], "doc_id long, text string")).withColumn("ids", F.lit(1)).withColumn("_t", F.lit("x"))
    got = {r.doc_id: r for r in digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), r.text
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    rows, vocabulary = encoded(docs.limit(20), RANKS, public_tokenizers.PATTERN)
    back = rows.withColumn("b", decoded(F.col("ids"), vocabulary)).join(docs.drop("ids"), "doc_id").collect()
    assert back and all(bytes(r.b) == (r.text or "").encode() for r in back)
    assert digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_leaves_no_literals_in_the_driver(spark, sf):
    """Descriptions of plans stay in the driver: none of them may hold the vocabulary, and the session's settings are as before."""
    sc, fields = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.debug.maxToStringFields")
    store = spark._jsparkSession.sharedState().statusStore()

    def ran():
        sc.listenerBus().waitUntilEmpty()
        every = store.executionsList()
        return {every.apply(i).executionId(): every.apply(i) for i in range(every.size())}

    before = set(ran())
    assert digests(spark.read.parquet(f"{sf}/documents.parquet").limit(20), RANKS, public_tokenizers.PATTERN).count() == 20
    new = {i: e for i, e in ran().items() if i not in before}
    assert new
    for i, e in new.items():
        nodes = store.planGraph(i).allNodes()
        assert len(e.physicalPlanDescription()) + sum(len(nodes.apply(n).desc()) for n in range(nodes.size())) < 200_000
    assert spark.conf.get("spark.sql.debug.maxToStringFields") == fields


def test_short_words_fold_as_long_ones(spark):
    """By packed numbers, one a step, or as words of any length: the same ids, for a made-up file in which a join ranks below its parts too."""
    import gable.llm.byte_bpe as m

    rng = random.Random(8)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"bcbc", b"abc", b"bc", b"ca", b"aa", b"cab", b"aaaa", b"ab"])}
    words = ["a", "ab", "abcbc", "a" * 47, "a" * 46, "é", *["".join(rng.choices("abc", k=rng.randrange(1, 47))) for _ in range(150)]]
    v = m.Vocabulary(ranks)
    both = m.bound(v.fold, lambda c: F.struct(F.transform(m.fold_short(c, F.col("w"), v.size), lambda x: x.bitwiseAND(m._MASK).cast("int")).alias("a"), m.fold_long(c, F.col("w"), v.size).alias("b")))
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", both.alias("x")).collect()
    assert len(got) == len(words) and all(r.x.a == r.x.b for r in got)


def pages(spark, n=230):
    rows = [(i, f"http://h/{i}", f"<p>{i} é</p>" * (i % 7)) for i in range(n)]
    return spark.createDataFrame([*rows, (500, None, None), (500, None, None), (None, "u", "h")], "page_id long, url string, html string")


def test_records_parse(spark, tmp_path):
    rows = archived(pages(spark), per_file=50).orderBy("file", "seq").collect()
    assert len(rows) == 233 and len({r.file for r in rows}) == 5
    (tmp_path / "w").mkdir()
    for f in {r.file for r in rows}:
        data = b"".join(bytes(r.record) for r in rows if r.file == f)
        assert [(o, n) for o, n, _, _ in parse(data)] == [(r.offset, r.first.size) for r in rows if r.file == f]
        (tmp_path / "w" / f"{f}.warc").write_bytes(data)
    back = read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.uri or "", bytes(r.payload)) for r in back) == sorted((r.url or "", (r.html or "").encode()) for r in pages(spark).collect())


def test_audit(spark):
    rows = archived(pages(spark), per_file=50)
    ours = index_of(rows, "first")
    assert audited(ours, ours).count() == 0 and audited(ours.limit(0), ours.limit(0)).count() == 0
    copy = F.when(F.col("page_id").isin(3, 77), F.concat("record", F.lit(b"x"))).otherwise(F.col("record"))
    damaged = index_of(rows.withColumn("copy", F.when(F.coalesce(F.col("page_id") != 40, F.lit(True)), measured(copy))), "copy")
    at = {r.page_id: (r.file, r.seq, r.offset, r.first.size) for r in rows.drop("record").collect()}
    more = ours.where((F.col("file") == at[9][0]) & (F.col("seq") == at[9][1])).withColumn("seq", F.lit(9999).cast("long"))
    bad = {(r.file, r.seq): r for r in audited(ours, damaged.unionByName(more), fanout=4).collect()}
    want = {at[3][:2]: "changed", at[77][:2]: "changed", at[40][:2]: "missing", (at[9][0], 9999): "extra"}
    assert {k: r.status for k, r in bad.items()} == want
    r = bad[at[77][:2]]
    assert (r.offset, r.length) == at[77][2:] and r.digest != r.replica_digest


def test_repeated_records_fill_no_file(spark):
    """2,500 equal records lie in three files at least, each row has a place, offsets are gapless."""
    rows = spark.range(2500).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html")).unionByName(pages(spark))
    got = archived(rows, per_file=100).select("file", "seq", "offset", "page_id", F.col("first.size").alias("n")).collect()
    assert len(got) == 2733 and len({r.file for r in got if r.page_id == 1}) >= 3
    files = {}
    for r in sorted(got):
        assert (r.seq, r.offset) == files.get(r.file, (0, 0))
        files[r.file] = (r.seq + 1, r.offset + r.n)
    assert placed(rows.limit(0).select("page_id", measured(F.lit(b"")).alias("first")), []).count() == 0


def test_tree_roots(spark):
    rows = index_of(archived(pages(spark), per_file=50), "first")
    k = levels_for(rows, 4)
    roots = tree(rows, k, 4).where(F.col("level") == k)
    assert roots.count() == 5 and roots.agg(F.max("node"), F.max("offset")).first()[:] == (0, 0)
    assert roots.agg(F.sum("size")).first()[0] == rows.agg(F.sum("size")).first()[0]


def test_long_words_in_order_of_ranks(spark, tmp_path):
    """Rank files in which a merge makes a pair that comes before others of its own rank: as the library does, at any length."""
    import base64

    import tiktoken

    rng = random.Random(3)
    # a token that a merge must wait for: abc, made of bc, ranks before bc
    files = [[b"bcbc", b"abc", b"bc", b"ca"], [b"aba", b"ab", b"aab", b"aa", b"aaaa"]]
    files += [sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(30)}, key=lambda _: rng.random()) for _ in range(6)]
    texts = ["abcbc" * 15, "abcbc" * 4, "a" * 333, "ab" * 100, "aab" * 70, *["".join(rng.choices("abc", k=rng.randint(40, 260))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, tokens in enumerate(files):
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        library = tiktoken.Encoding(f"made{n}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rows, _ = encoded(docs, str(path), public_tokenizers.PATTERN)
        got = {r.doc_id: list(r.ids) for r in rows.collect()}
        assert all(got[i] == library.encode_ordinary(t) for i, t in enumerate(texts)), n
