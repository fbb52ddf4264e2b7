import hashlib
import re

from pyspark.sql import functions as F

from stayline.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def check(docs):
    found = {(r.doc_id, r.base_sha256): r for r in secrets.secret_spans(docs).collect()}
    for row in docs.select("doc_id", "text").collect():
        spans = brute(row.text)
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        got = found[row.doc_id, hashlib.sha256(base.encode()).hexdigest()]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert [s for s in got.spans.split(",") if s and not s.startswith("owned")] == [s for s in base.split(",") if s]
    assert secrets.secret_spans(docs).count() == docs.count()


def test_base_spans_of_all_documents(tables):
    check(tables("documents"))


def test_odd_documents(odd_docs, no_docs, spark):
    check(odd_docs)
    assert secrets.secret_spans(no_docs).count() == 0
    texts = ["é PassWord = 'abcdef' x", "api_key:abc token=x secret : \"a-b/c=d.e\"", "AKIA" + "A" * 16 + " AKIA" + "B" * 15,
             "f" * 24 + "g" + "a" * 23, "token=AKIA" + "C" * 20, "tokentoken=abcdefg passwd==abcdefgh", "ſecret=abcdefg"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s")))


def test_ownership_parts_copied_examples_from_live_values(spark):
    live, copied = "Zk8Qw3Rt7Yp1Lm5Nv9Bx2Cd4", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = [(1, f"x {live} y", "o1"), (2, f"z {live}", "o1"), (3, copied, "o1"), (4, copied, "o2"),
            (5, "password=hunter2hunter2 " + copied, "o3"), (6, "token: EXAMPLE_your_1234567", "o4")]
    out = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[1].spans == f"owned:2:{2 + len(live)}" and out[1].n_owned == out[1].n_live == 1
    assert out[3].spans == out[4].spans == "" and out[3].n_example == 0
    assert out[5].spans == "assign:0:23" and out[5].n_example == 1
    assert out[6].n_assign == 1 and out[6].n_live == 0


def test_both_counts_decide_what_is_copied(spark):
    page, own, copied = "Zk8Qw3Rt7Yp1Lm5Nv9Bx2Cd4", "Hq5Wd8Jr2Xs6Ft3Kz7Vb1Gn9", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = [(1, page, "o1"), (2, page, "o2"), (3, copied, "o1"), (4, copied, "o2"), (5, copied, "o2")]
    rows += [(i, own, "o1") for i in range(100, 200)]
    out = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {i for i, r in out.items() if r.n_owned == r.n_live == 1} == {1, 2, *range(100, 200)}
    assert all(out[i].spans == "" and out[i].n_live == 0 for i in (3, 4, 5))


def test_counts_of_repositories_and_owners(spark):
    rows = [("h", "r1", "o1"), ("h", "r1", "o1"), ("h", "r2", "o1"), ("h", "r3", "o2"), ("g", None, None)]
    found = secrets.ownership(spark.createDataFrame(rows, "hash string, repo string, owner string")).collect()
    assert sorted((r.hash, r.n_repos, r.n_owners) for r in found) == [("g", 1, 1), ("h", 3, 2)]
