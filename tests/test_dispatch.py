"""Requests that are sent once, whatever fails; closures of sources."""

import hashlib
import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

from veritrail.operators import dispatch, lineage

ROOT = str(Path(__file__).resolve().parent.parent)


def test_a_retried_task_sends_nothing_twice(tmp_path):
    """Tasks die after some of their requests; Spark runs them again; every key was sent once and all is answered or uncertain."""
    script = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from veritrail.operators import dispatch
        from veritrail.runtime import prepare
        spark = prepare(SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.python.worker.reuse", "false").getOrCreate())
        calls = {str(tmp_path / "calls")!r}
        os.makedirs(calls)
        def send(request):
            with open(os.path.join(calls, request.split('"n":')[1].split("}}")[0].strip('"') + "." + os.urandom(4).hex()), "w"):
                pass
            if '"n":13' in request and TaskContext.get().attemptNumber() == 0:
                os._exit(1)  # the machine is lost after it has sent the request and before the receipt is there
            if request.endswith('"n":7}}'):
                raise ConnectionError("refused")
            return '{{"label":"a"}}'
        rows = spark.range(40).select((F.col("id") % 20).alias("n"))
        ledger = dispatch.FolderLedger({str(tmp_path / "ledger")!r})
        made = dispatch.prepared_requests(rows, "m", n="n").repartition(3)
        for run in range(2):
            for r in sorted(map(tuple, dispatch.dispatched(made, send, ledger).select("outcome", "error", "replayed").collect()), key=repr):
                print("ROW", run, *r)
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    rows = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROW")]
    calls = sorted(name.split(".")[0] for name in os.listdir(tmp_path / "calls"))
    assert calls == sorted(map(str, range(20))), done.stderr[-2000:]
    first, second = [r[1:] for r in rows if r[0] == "0"], [r[1:] for r in rows if r[0] == "1"]
    assert len(first) == len(second) == 20
    for got in (first, second):
        assert sum(r[0] == "answered" for r in got) == 18 and [r[:2] for r in got if r[0] == "failed"] == [["failed", "ConnectionError"]] and sum(r[0] == "outcome_uncertain" for r in got) == 1
    assert all(r[2] == "True" for r in second if r[0] != "outcome_uncertain")


def test_ledger(tmp_path):
    ledger = dispatch.FolderLedger(str(tmp_path / "l"))
    assert ledger.receipt("abc") is None and ledger.claim("abc") and not ledger.claim("abc") and ledger.claim("abd")
    ledger.store("abc", b"x")
    assert ledger.receipt("abc") == b"x" and ledger.receipt("abd") is None


def test_decision_records(spark):
    labels = ["a", "b", "uncertain"]
    good = {"label": "a", "probabilities": {"a": 0.7, "b": 0.3}}
    cases = [
        ("answered", json.dumps(good), None, ("succeeded", "a", None)), ("answered", json.dumps({**good, "probabilities": {"a": 0.5, "b": 0.5}}), None, ("succeeded", "uncertain", None)),
        ("answered", "{", None, ("failed", None, "invalid_response")), ("answered", None, None, ("failed", None, "invalid_response")), ("answered", json.dumps({**good, "label": "c"}), None, ("failed", None, "label_not_allowed")),
        ("answered", json.dumps({"label": "a"}), None, ("failed", None, "missing_probabilities")), ("answered", json.dumps({**good, "probabilities": {"a": 0.7, "z": 0.3}}), None, ("failed", None, "label_not_allowed")),
        ("answered", json.dumps({**good, "probabilities": {"a": 0.7, "b": 0.4}}), None, ("failed", None, "invalid_probabilities")), ("answered", json.dumps({**good, "probabilities": {"a": 1.2, "b": -0.2}}), None, ("failed", None, "invalid_probabilities")),
        ("answered", json.dumps({**good, "label": "b"}), None, ("failed", None, "label_not_most_probable")), ("failed", None, "TimeoutError", ("failed", None, "TimeoutError")), ("outcome_uncertain", None, "uncertain", ("failed", None, "outcome_uncertain")),
    ]
    table = spark.createDataFrame([(str(n), *c[:3], False) for n, c in enumerate(cases)], dispatch.RESPONSE)
    got = {int(r.work_key): r for r in dispatch.decision_records(table, labels).collect()}
    assert [(got[n].status, got[n].label, got[n].error) for n in range(len(cases))] == [c[3] for c in cases]
    assert [n for n in got if got[n].retryable] == [10]
    tied = dispatch.decision_records(table.where("work_key = '1'"), ["a", "b"]).first()
    assert (tied.status, tied.error) == ("failed", "tied_labels")


def plain_closure(records, edges):
    """By recursion."""
    below = {}
    for src, dst in set(edges):
        below.setdefault(src, []).append(dst)
    known = {}

    def of(i, path=()):
        if i not in records or i in path:
            return None
        if i not in known:
            parts = [of(d, (*path, i)) for d in below.get(i, [])]
            if any(p is None for p in parts):
                return None
            sums = [sum(int(h[8 * k : 8 * k + 8], 16) for _, h in parts) for k in range(8)]
            said = [records[i], str(len(parts)), *(map(str, sums) if parts else [])]
            known[i] = (1 + max((n for n, _ in parts), default=-1), hashlib.sha256(":".join(said).encode()).hexdigest())
        return known[i]

    return {i: of(i) or (-1, None) for i in records}


def test_closures_equal_recursion(spark):
    records = {f"n{i}": f"d{i % 7}" for i in range(60)}
    edges = [(f"n{i}", f"n{i // 2}") for i in range(1, 40)] + [(f"n{i}", f"n{i // 3}") for i in range(1, 40)] + [("n50", "n51"), ("n51", "n50"), ("n52", "n50"), ("n53", "gone"), ("n54", "n53"), ("n55", "n55"), ("n30", "n15")]
    edges = [e for e in edges if e[0] != e[1] or e[0] == "n55"]
    table, links = spark.createDataFrame(list(records.items()), "id string, digest string"), spark.createDataFrame(edges, "src string, dst string")
    want = plain_closure(records, edges)
    got = {r.id: (r.level, r.closure) for r in lineage.closure_hashes(table, links).collect()}
    assert got == want and got["n52"] == (-1, None) and got["n54"] == (-1, None)
    changed = {**records, "n9": "other"}
    now = {r.id: r.closure for r in lineage.closure_hashes(spark.createDataFrame(list(changed.items()), "id string, digest string"), links).collect()}
    moved = {i for i in records if now[i] != got[i][1]}
    above = {"n9"}
    while more := {s for s, d in edges if d in above} - above:
        above |= more
    assert moved == above
    assert lineage.closure_hashes(table.where("false"), links).collect() == []


def test_stale_indexes(spark):
    now = spark.createDataFrame([("m1", "c1", "i1"), ("m2", "c2", "i9")], "id string, closure string, index_id string")
    before = spark.createDataFrame([("m1", "i1"), ("m2", "i2"), ("m3", "i3")], "id string, index_id string")
    assert sorted(map(tuple, lineage.stale(before, now).collect())) == [("m2", "index_corpus_mismatch"), ("m3", "index_source_missing")]
