"""Queries cover every row of their tables and whole texts."""
from pyspark.sql import functions as F

from huntspark.checks import joins, normalize, questions, rollups, sources
from huntspark.checks.base import evidence, table

SF = "/root/testdata/sf0.001"


def whole(module, name):
    return module.CHECKS[name][0]


def test_joins_take_all_rows(spark):
    orders = table(spark, SF, "orders")
    assert whole(joins, "J16_confirm_lateral")(spark, SF).count() == orders.count()
    ip = {r.host: r.ip for r in whole(joins, "J21_host_ip_map")(spark, SF).collect()}
    best: dict = {}
    for r in orders.select("o_custkey", "o_orderpriority").collect():
        host = f"Customer#{r.o_custkey:09d}"
        best[host] = max(best.get(host, ""), f"10.2.{r.o_orderpriority[0]}.9")
    assert {h: ip[h] for h in best} == best
    items = table(spark, SF, "lineitem")
    returned = {r[0] for r in items.where("l_returnflag = 'A'").select("l_orderkey").collect()}
    assert {r.stage_id for r in whole(joins, "J22_attach_join_ids")(spark, SF).collect()} == returned
    refs: dict = {}
    for r in items.where("l_returnflag <> 'N'").select("l_orderkey", "l_returnflag", "l_partkey").collect():
        refs.setdefault((r.l_returnflag, r.l_orderkey), set()).add(r.l_partkey)
    matrix = set().union(*[v for (f, _), v in refs.items() if f == "A"])
    alone = {-o for (f, o), v in refs.items() if f == "R" and not v & matrix}
    assert {r.stage_id for r in whole(joins, "J22_merge_stages")(spark, SF).collect()} == returned | alone


def test_paths_meet_whole_paths(spark):
    paths = {r.page_id: r.path for r in joins._paths(spark, SF)[0].collect()}
    want = sorted((a, b) for a, p in paths.items() for b, q in paths.items() if p and q and (p.startswith(q) or q.startswith(p)))
    assert sorted(tuple(r) for r in whole(joins, "J02_path_prefix")(spark, SF).collect()) == want


def test_trace_takes_all_web_and_exec_rows(spark):
    found = {r.host for r in whole(questions, "Q4_intrusion_trace")(spark, SF).collect()}
    rows = evidence(spark, SF).where("event_type IN ('signup', 'click')").select((F.col("user_id") % 30).alias("h")).distinct()
    assert {f"h{r.h}" for r in rows.collect()} <= found
    seen = []
    keep = questions.trace_intrusion
    questions.trace_intrusion = lambda tables, *a, **k: seen.append({n: t.count() for n, t in tables.items()}) or keep(tables, *a, **k)
    try:
        whole(questions, "Q4_intrusion_trace")(spark, SF)
    finally:
        questions.trace_intrusion = keep
    n = {r.event_type: r["count"] for r in evidence(spark, SF).groupBy("event_type").count().collect()}
    assert (seen[0]["web_access_log"], seen[0]["host_exec"]) == (n["signup"], n["click"])


def _documents(spark, tmp_path, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_highlights_are_whole_texts(spark, tmp_path):
    d = _documents(spark, tmp_path, ["the same start, one end", "the same start, other end"])
    assert {r.snippet for r in whole(rollups, "A21_host_highlights")(spark, d).collect()} == {"the same start, one end", "the same start, other end"}


def test_secrets_behind_the_header_are_seen(spark, tmp_path):
    d = _documents(spark, tmp_path, ["plain " * 40 + "--token s3cret tail", "mysql --password=hunter2 end"])
    clean = {r.doc_id: r.clean for r in whole(normalize, "P26_redact_secrets")(spark, d).collect()}
    assert clean[0].endswith("plain --token [REDACTED] tail") and clean[1].endswith("mysql --password=[REDACTED] end")


def test_evidence_ids_are_whole(spark):
    ids = [r.evidence_id for r in whole(normalize, "P07_normalize_events")(spark, SF).collect()]
    assert all(len(i) == 45 and i.startswith("host-exec-v2-") for i in ids) and len(set(ids)) == len(ids) == table(spark, SF, "events").count()


def test_order_guard_keeps_the_partitions(spark, tmp_path, monkeypatch):
    table(spark, SF, "events").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    seen, follow = [], sources.T.follow_files
    monkeypatch.setattr(sources.T, "follow_files", lambda s, path, *a, **k: seen.append(len(s.read.parquet(path).inputFiles())) or follow(s, path, *a, **k))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = sorted(tuple(r) for r in sources.t08(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == 8 and got == sorted(tuple(r) for r in sources.t08(spark, SF).collect())
