import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stepweave.llm import bpe, chat, fingerprint, pii, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, text_ string, N_TOKENS int, spans int, fingerprint int"
ODD = [(1, None, None, 0, 0, 0), (2, "", "", 0, 0, 0), (None, "a b c", "x", 1, 1, 1), (3, "ab " * 30000, None, 1, 1, 1), (3, "ab " * 30000, None, 1, 1, 1), (4, "x" * 50000, "", None, None, None), (5, "mail a@b.cc_d@e.fr now", "", 1, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library_on_random_texts():
    random.seed(5)
    t, c = tokenizer(), bpe.codec(bpe.default_path())
    pool = [chr(i) for i in range(1, 0x250)] + ["<|endoftext|>", " ", "  ", "\n", "aa", "aaa", "é", "😀", "\x1c", "　", "'s", "12", "the", "ing"] * 40
    for _ in range(4000):
        s = "".join(random.choices(pool, k=random.randint(0, 14)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == ids
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False) == s
    for s in ("a" * 20000, "ab" * 9000, " " * 5000, "!" * 3001):
        assert c.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_bpe_query(spark):
    t = tokenizer()
    for r in queries.op1_bpe(spark, SF).join(queries.documents(spark, SF), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(odd):
    rows = bpe.encode_decode(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.decoded_text for r in rows] == [x[1] or "" for x in ODD]
    assert "N_TOKENS" not in rows[0].asDict() and rows[0].n_tokens == 0
    assert bpe.encode_decode(odd.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 9 <= len(d) <= 15
            if kind == "card" and 12 <= len(d) <= 19:
                ok = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return [(b, e, kind) for b, _, e, kind in sorted(found)]


def test_pii_base_equals_the_patterns():
    random.seed(2)
    pool = ["a", "b", "@", ".", "-", "1", "2", "255", "256", "+1", " ", "(", ")", "_", "é", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", "79927398713", "4111111111111111"]
    for _ in range(20000):
        s = "".join(random.choices(pool, k=random.randint(0, 25)))
        assert pii.base_spans(s) == plain_spans(s), s


def test_pii_bootstrapping_finds_what_its_context_tells(spark):
    docs = [(i, f"please call phone +1 (017) 555-77{i:02d} now") for i in range(20)] + [(100, "please call phone 1(017)555-7799 now"), (101, "nothing here but 1234567 words")]
    # the unseen shape must equal a seed's: patterns carry it
    docs += [(200 + i, f"account iban 4111111111111{i:03d} ok") for i in range(100)]
    df = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"), confidence=0.05)
    rows = {r.doc_id: r for r in df.collect()}
    assert all(len(rows[i].base) == 1 for i in range(20))
    assert not rows[101].spans
    good = [i for i in range(200, 300) if rows[i].base]
    assert good and all(rows[i].spans and rows[i].spans[0].kind == "card" for i in range(200, 300))


FORMATS = ["1(017)555-7799", "017 555 77 99", "(017) 555-7799", "1.017.555.7799", "017 - 555 - 7799", "0175557799", "017/555/7799"]


def test_pii_bootstrapping_finds_new_formats_at_the_confidence_in_use(spark):
    docs = [(i, f"please call phone +1 (017) 555-77{i:02d} now") for i in range(60)]
    docs += [(100 + i, f"please call phone {x} now") for i, x in enumerate(FORMATS)] + [(200, "nothing here but 1234567 words"), (201, "in phone 12 now 34")]
    rows = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, x in enumerate(FORMATS):
        text = docs[60 + i][1]
        assert not rows[100 + i].base and [(s.kind, text[s.begin : s.end]) for s in rows[100 + i].spans] == [("phone", x)], x
    assert not rows[200].spans and not rows[201].spans


def test_pii_bootstrapping_induces_patterns_round_by_round(spark):
    """Values found beside seeds induce a context without any seed, at default settings; what that adds induces nothing in one round."""
    new = [f"017 555 {i:02d} 99" for i in range(25)]
    docs = [(i, f"please call phone +1 (017) 555-77{i:02d} now") for i in range(60)] + [(100 + i, f"please call phone {x} now") for i, x in enumerate(new)]
    docs += [(200 + i, f"reachable under {x} daily") for i, x in enumerate(new)] + [(300, "reachable under 017/4321/88 daily"), (301, "ordered under 017/4321/88 daily"), (302, "size 12345 weekly")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    found = {i: [(s.kind, dict(docs)[i][s.begin : s.end]) for s in r.spans] for i, r in rows.items()}
    assert all(found[100 + i] == found[200 + i] == [("phone", x)] for i, x in enumerate(new))
    assert found[300] == [("phone", "017/4321/88")] and not found[302]
    one = {r.doc_id: r.spans for r in pii.find_personal_data(df, rounds=1).collect()}
    assert not any(spans for i, spans in one.items() if i >= 200)


def test_pii_contexts_are_whole_words():
    text = "x" * 60 + " " + "y" * 60 + " here 12345 and " + "z" * 60
    assert pii.contexts(text, text.index("1"), text.index("5") + 1) == ["L here", "R and"]
    assert pii.contexts("call 1", 5, 6) == ["L call"] and pii.contexts("1 " + "w" * 47, 0, 1) == [f"R {'w' * 47}"]


def test_pii_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 2, 3, 4, 5, 6)], "row long, text string, seen int, _row int, _more int, more int, base int")
    got = pii.find_personal_data(df).collect()
    assert [tuple(r)[:6] for r in got] == [(1, "mail a@b.cd", 2, 3, 4, 5)] and got[0].base == got[0].spans and len(got[0].base) == 1


def test_pii_unseen_runs_stay_apart():
    found = lambda t: [t[b:e] for b, e in pii.unseen(t, pii.base_spans(t))]
    assert found("a 12345678 87654321 b") == ["12345678", "87654321"]
    assert found("a 555 1234. 12345 b, 55512, 12345") == ["555 1234", "12345", "55512", "12345"]
    assert found("12345 +1 (017) 555-7713 b") == ["12345"]
    assert found("x@y 123 4567 abc123 4567 89") == ["x@y", "123 4567", "4567 89"]


def test_pii_odd_rows(odd):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD) and "text_" in rows[0].asDict()
    assert [len(r.base) for r in rows if r.doc_id == 5] == [2]
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    red = pii.redact(pii.find_personal_data(odd)).where("doc_id = 5").first().text
    assert red == "mail [EMAIL][EMAIL] now"


def test_pii_query(spark):
    for r in queries.op2_pii(spark, SF).join(queries.documents(spark, SF), "doc_id").collect():
        base = plain_spans(r.text or "")
        text = ",".join(f"{k}:{b}:{e}" for b, e, k in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(","))
        assert r.n_card == sum(k == "card" for _, _, k in base)


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(con.execute(queries.OP6_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op6_chat(spark, SF).collect())
    assert got == want


def test_chat_templates_that_rewrite_long_histories_alone():
    """Whatever the length from which a template rewrites, and also if its rendering of the whole doesn't show it."""
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(200)]

    def omits(some):  # over 130 turns an odd number of them loses the first three
        return chat.render(some[3:] if len(some) > 130 and len(some) % 2 else some)

    with pytest.raises(chat.HistoryRewritten):
        chat.locate(turns, omits)
    assert chat.locate(turns[:130], omits)[0] == chat.render(turns[:130])
    with pytest.raises(chat.HistoryRewritten):
        chat.locate(turns[:132], lambda some: chat.render(some) if len(some) != 131 else "")
    many = turns * 10
    out, places = chat.locate(many)
    assert chat.parse(out) == many and len(places) == 2000 and [chat.unescape(out[b:e]) for _, _, b, e in places] == [t for _, t in many]


def test_chat_escapes_reversibly():
    random.seed(9)
    for _ in range(5000):
        turns = [(random.choice(["user", "assistant", "a b: c", ""]), "".join(random.choices(["\\", "### Assistant: ", "</turn>", "\n", " ", "x", "###", ": "], k=random.randint(0, 8)))) for _ in range(3)]
        out, places = chat.locate(turns)
        assert chat.parse(out) == turns
        assert [chat.unescape(out[b:e]) for _, _, b, e in places] == [t for _, t in turns]


def test_chat_detects_rewritten_history_and_long_conversations(spark):
    with pytest.raises(chat.HistoryRewritten):
        chat.locate([("user", "a"), ("assistant", "b")], lambda turns: f"{len(turns)}:" + chat.render(turns))
    turns = [("user", str(i)) for i in range(1000)]
    out, places = chat.locate(turns)
    assert out == chat.render(turns) and out[places[777][2] : places[777][3]] == "777"
    numbered = lambda turns: "".join(f"{i} {chat.render([t])}" for i, t in enumerate(turns))
    assert chat.locate(turns[:300], numbered)[0] == numbered(turns[:300])


def test_chat_odd_rows(spark):
    rows = [(1, 1, None, None, 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (None, None, "assistant", "z" * 100000, 1), (None, 1, "user", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert [t.text for t in got[1].turns] == ["a", "a", ""] and len(got[None].turns) == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_fingerprint_query(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in queries.documents(spark, SF).collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    gap = []
    for i, (d, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(t)
        w = lambda x: {tuple(v[i : i + 5]) for v in [x.lower().split()] for i in range(max(1, len(v) - 4))}
        a, b = w(t), w(e)
        gap.append(abs(len(a & b) / len(a | b) - got[d].near_edited))
    assert sum(gap) / len(gap) < 0.04 and max(gap) < 0.25
    same = {}
    for d, t in docs:
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprint_odd_rows(odd, parts):
    rows = fingerprint.compare_edited(odd, parts=parts).collect()
    assert len(rows) == len(ODD) and {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.compare_edited(odd.limit(0)).count() == 0
    assert fingerprint.compare_edited(odd.where("doc_id = 3").limit(1)).first().near_next == 1.0
    assert fingerprint.fingerprints(odd).select(F.sum(F.length("fingerprint"))).first()[0] == 256 * 5


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_of_many_rows_of_one_id(spark, parts):
    """Texts of one id are dealt to several ranges, in the order of their hashes; each is followed by the right one."""
    rows = [(5, f"text {i} of the same id " * (i % 9 + 1)) for i in range(300)] + [(None, "of no id"), (9, ""), (2, None), (5, "text 3 of the same id " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r.doc_id, r.text or "") for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64(F.coalesce("text", F.lit(""))))).collect()]
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((d or -1, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprint.compare_edited(df, parts=parts).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
