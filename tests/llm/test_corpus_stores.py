"""The prefix trie, the filter audit and the archives: against SQL over planted rows, brute force and round trips."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from rolecall.llm import filter_audit, prefix_trie, warc
from tests.conftest import rows

TURNS = "conv_id long, turn long, role string, text string, digest string, depth long, n_convs string"


def _turns(spark, given):
    """Conversations with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*t, "x", 7, "y") for t in given], TURNS)


def _given(seed=4):
    rng = random.Random(seed)
    out = [(None, 1, "user", "no id"), (5, None, None, None), (5, None, "user", "first"), (5, 3, "user", "same"), (5, 3, "user", "same"), (-7, 1, "user", "below zero")]
    for conv in range(20, 90):
        if conv % 9 == 0 or conv == 40:
            continue  # 40 is a base that is absent
        out += [(conv, k, rng.choice(("user", "assistant", None)), rng.choice(("a b", "a b c", "", None, "ÄÖ  ü"))) for k in range(rng.choice((0, 1, 2, 3, 5, 9)))]
    out += [(100, k, "user", f"turn {k}") for k in range(300)]
    return out


@pytest.mark.parametrize("given", [_given(), [], [(40, 1, "user", "x")], [(None, 1, "u", "x")]])
def test_rebuilt_trie_equals_sql(spark, given):
    items = prefix_trie.turn_items(_turns(spark, given))
    got = prefix_trie.trie(prefix_trie.rebuilt(items), items.select("conv_id").distinct()).drop("digest")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if given:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", given)
    assert rows(got) == rows(con.sql(prefix_trie.OP11_SQL))


def test_trie_equals_brute_force(spark):
    """Conversations as they stand, by a plain walk from every node to all its ancestors."""
    given = [(c, t, r, x) for c, t, r, x in _given() if c is not None]
    seqs = {c: [(r or "", x or "") for _, r, x in sorted(((-1 if t is None else t, r or "", x or "") for d, t, r, x in given if d == c))] for c in {g[0] for g in given}}
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, of in members.items():
        leaf = all(len(seqs[c]) == len(node) for c in of)
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1].split()) if node else 0)
            leaves[node[:d]] += leaf
    want = sorted(
        (of[0], len(node), members[node[:-1]][0] if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in of if len(seqs[c]) == len(node)).encode()).hexdigest())
        for node, of in members.items()
    )
    assert sorted(map(tuple, prefix_trie.prefix_trie(_turns(spark, given)).drop("digest").collect()), key=str) == sorted(want, key=str)


def test_ids_of_one_node_in_several_chunks(spark):
    """More members than one chunk of ids holds, negative ones among them, and a hot node beyond the share of ``join_hot``."""
    ids = [*range(-9000, 9000, 3), 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "conv_id long").select("conv_id", F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("hello you").alias("text"))
    root, node = prefix_trie.prefix_trie(df).orderBy("depth").collect()
    assert node["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and root["ends_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"], node["saved_tokens"]) == (len(ids), 1, 1, 2 * (len(ids) - 1), 2 * (len(ids) - 1))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, good long, A boolean"
LONG = " ".join(f"w{k}" for k in range(120))
TEXTS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (1, LONG, "fr"), (None, LONG, "en"), (3, None, None), (4, "", ""), (5, " \n", "en"), (6, "the " * 200, "en"), (7, LONG.upper(), "en"),
    (8, f"{LONG} | x", "de"), (9, "A$", "de"), (10, "ÄÖÜ É", "de"), (11, "x" * 100_000, "en"), (12, " ".join(f"W{k % 79}" for k in range(100)), "en"), (13, " ".join(f"v{k % 80}" for k in range(100)), "en"), (14, "ABC", "en"), (15, "ABC", "xx"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (9, None, None), (None, 1, 1), (14, 1, 1), (15, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize(("texts", "labels"), [(TEXTS, LABELS), (TEXTS, []), (TEXTS[:1], LABELS)])
def test_audit_equals_sql(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "d", "p", 1, True) for i, t, lang in texts], DOCS)
    known = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    cells = filter_audit.labelled_cells(filter_audit.failures(docs), known, "ABCDE")
    got = filter_audit.audit(cells, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", texts)
    if labels:
        con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert rows(got) == rows(con.sql(filter_audit.OP12_SQL))


def test_audit_of_random_cells_equals_a_walk(spark):
    """Every order applied row by row; Shapley counts add up to all failures times the orders."""
    rng, filters = random.Random(1), "PQR"
    cells = [("x", *(rng.random() < 0.4 for _ in filters), rng.randrange(9), rng.randrange(3)) for _ in range(12)]
    df = spark.createDataFrame(cells, "part string, P boolean, Q boolean, R boolean, n long, bad long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(df, filters, {"bad_lost": "bad"}).collect()}
    shapley = defaultdict(int)
    for order in permutations(filters):
        left = cells
        for k, f in enumerate(order):
            at = 1 + filters.index(f)
            gone, left = [c for c in left if c[at]], [c for c in left if not c[at]]
            row = got["".join(order), k + 1]
            fails = [c for c in cells if c[at]]
            assert (row["kept"], row["removed"], row["bad_lost"]) == (sum(c[4] for c in left), sum(c[4] for c in gone), sum(c[5] for c in gone))
            assert row["redundant"] == sum(c[4] for c in fails) - row["removed"] and row["unique_fails"] == sum(c[4] for c in fails if sum(c[1:4]) == 1)
            shapley[f] += row["removed"]
    assert all(got[o, s]["shapley"] == shapley[o[s - 1]] for o, s in got) and len(got) == 18
    assert sum(shapley.values()) == 6 * sum(c[4] for c in cells if any(c[1:4]))


def test_audit_without_rows(spark):
    none = spark.createDataFrame([], DOCS)
    cells = filter_audit.labelled_cells(filter_audit.failures(none), spark.createDataFrame([], "doc_id long, quality int, toxic int"), "ABCDE")
    assert filter_audit.audit(cells, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"}).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "ABCDEFGHI", {})


PAGES = "page_id long, url string, html string, digest string, bytes string, shard string"
#: Small shards and files, so that both are cut.
SMALL = warc.Settings(shard_bytes=4000, file_bytes=900)


def _pages(spark, n=120, seed=2):
    rng = random.Random(seed)
    given = [(k, f"http://h{k % 5}.example/{k}", rng.choice(("same payload", "ä" * 40, None, "", f"own {k} " + rng.randbytes(rng.randrange(300)).hex()))) for k in range(n)]
    given += [(None, None, "same payload"), (None, "http://x/\r\nWARC-Type: a b", "only without an id"), (7, "http://other/", "ä" * 40), (119, "http://h4.example/119", "twice"), (119, "http://h4.example/119", "twice"), (500, "http://long/", "z" * 300_000)]
    return given, spark.createDataFrame([(*g, "d", "b", "s") for g in given], PAGES)


def _files(spark, folder):
    return {r["name"]: (r["records"], r["sha256"], r["shard"]) for r in warc.manifest(spark, folder).collect()}


def test_archive_round_trip(spark, tmp_path):
    given, df = _pages(spark)
    folder = f"file://{tmp_path}/a"
    warc.write_archive(df, folder, SMALL)
    got = warc.read_archive(spark, folder).collect()
    last = {}
    for page, _, html in given:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    want = [(p, len((h or "").encode()), warc._sha1((h or "").encode()), *(("revisit", last[h or ""]) if last[h or ""] >= 0 and p != last[h or ""] else ("response", None))) for p, _, h in given]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    texts = {(r["page_id"], r["payload_digest"]): r["html"] for r in got if r["record_type"] == "response"}
    assert all(texts[p if last[h or ""] < 0 else last[h or ""], warc._sha1((h or "").encode())] == (h or "") for p, _, h in given)
    files = _files(spark, folder)
    assert len({s for _, _, s in files.values()}) > 2 and len(files) > len({s for _, _, s in files.values()})
    for name, (_, digest, _) in files.items():
        raw = (tmp_path / "a" / name).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == digest and gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert {p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".gz"} == set(files) and not (tmp_path / "a/_temporary").exists()


def test_archive_is_the_same_in_any_partitions(spark, tmp_path):
    _, df = _pages(spark)
    for k, parts in enumerate((df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)))):
        warc.write_archive(parts, f"file://{tmp_path}/{k}", SMALL)
    assert _files(spark, f"file://{tmp_path}/0") == _files(spark, f"file://{tmp_path}/1") == _files(spark, f"file://{tmp_path}/2")


def test_order_ids_and_least_bytes(spark, tmp_path):
    _, df = _pages(spark)
    folder = f"file://{tmp_path}/a"
    warc.write_archive(df, folder, SMALL._replace(least_bytes=20))
    got = warc.read_archive(spark, folder)
    assert got.where("record_type = 'revisit' and payload_bytes < 20").count() == 0 < got.where("record_type = 'revisit'").count()
    ids, named = [], []
    for name in sorted(_files(spark, folder)):
        with open(tmp_path / "a" / name, "rb") as f:
            for head, _ in warc.records_of(f, most=100):
                named.append(head)
                if head["warc-type"] != "warcinfo":
                    ids.append(int(head.get("page-id", -1)))
    assert ids == sorted(ids)
    assert len({h["warc-record-id"] for h in named}) == len(named), "every record has an id of its own"
    assert all(any(h["warc-refers-to"] == o["warc-record-id"] and o["warc-type"] == "response" for o in named) for h in named if h["warc-type"] == "revisit")


def test_archive_commits_once_and_after_a_death(spark, tmp_path):
    _, df = _pages(spark)
    folder = f"file://{tmp_path}/a"
    (tmp_path / "a/_temporary/dead").mkdir(parents=True)
    (tmp_path / "a/_temporary/dead/part-0000000-00000.warc.gz").write_bytes(b"half")
    (tmp_path / "a/part-0000099-00000.warc.gz").write_bytes(b"of no manifest")
    warc.write_archive(df, folder, SMALL)
    assert warc.read_archive(spark, folder).count() == df.count()
    with pytest.raises(FileExistsError):
        warc.write_archive(df, folder, SMALL)


@pytest.mark.parametrize("harm", ["cut", "payload"])
def test_harmed_archives_are_noticed(spark, tmp_path, harm):
    _, df = _pages(spark, n=5)
    folder = f"file://{tmp_path}/a"
    warc.write_archive(df, folder)
    path = next(p for p in (tmp_path / "a").iterdir() if p.suffix == ".gz")
    raw = path.read_bytes()
    if harm == "cut":
        path.write_bytes(raw[: len(raw) // 2])
    else:
        path.write_bytes(gzip.compress(gzip.decompress(raw).replace(b"twice", b"zwice"), mtime=0))
    with pytest.raises(Exception, match="ends within a record|differs from its digests|not a record"):
        warc.read_archive(spark, folder).count()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/a")
    assert warc.read_archive(spark, f"file://{tmp_path}/a").count() == 0


def test_members_end_where_reads_end():
    """A member boundary may fall on any read."""
    class Bytes:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    whole = b"".join(warc._record("response", b"x" * k, {"Page-ID": str(k)}, 6) for k in range(5))
    for most in (1, 7, 64, len(whole)):
        assert [(h["page-id"], b) for h, b in warc.records_of(Bytes(whole), most)] == [(str(k), b"x" * k) for k in range(5)]
    assert zlib.decompress(whole, 31).startswith(b"WARC/1.1")
