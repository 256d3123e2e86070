import json

import pytest

from tessera import engine as N
from tessera.__main__ import main, parser, repl
from tessera.plans.config import IndexConfig
from tessera.server import OPERATIONS, respond, search_config, server
from tessera.sources import readers as R
from tessera.sources import sinks
from tessera.streaming.ingest import corpus_stream, index_stream, open_index


@pytest.fixture(scope="module")
def corpus_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = [
        {"_id": "a", "title": "red fox", "text": "The red fox runs. It likes cold rivers. Nobody knows why."},
        {"_id": "b", "title": "blue fish", "text": "A blue fish swims in cold rivers."},
        {"_id": "c", "title": "empty", "text": ""},
    ]
    (path / "corpus.jsonl").write_text("\n".join(json.dumps(d) for d in docs))
    return str(path / "corpus.jsonl")


def test_readers(spark, tmp_path, corpus_path):
    assert sorted(r.doc_id for r in R.read_corpus(spark, corpus_path).collect()) == ["a", "b"]
    rows = spark.createDataFrame([("1", None, "t"), (None, "2", "u"), ("3", None, "")], "_id string, id string, text string")
    assert sorted((r.doc_id, r.title) for r in R.corpus_of(rows).collect()) == [("1", ""), ("2", "")]
    (tmp_path / "q.jsonl").write_text('{"_id":"1","text":"x","metadata":{"a":[{"sentences":[0,2],"label":"SUPPORT"}]}}\n{"_id":"2","text":"y","metadata":{}}\n{"_id":"3","text":"z"}')
    got = {r.qid: r.metadata for r in R.read_queries(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got["1"]["a"][0].sentences == [0, 2] and got["2"] == got["3"] == {}
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1.0\n1\ta\t0\n2\tb\t2\n")
    assert sorted(tuple(r) for r in R.read_qrels(spark, str(tmp_path / "q.tsv")).collect()) == [("1", "a", 1), ("2", "b", 2)]


def test_finance_is_seen(spark, corpus_path):
    docs = R.read_corpus(spark, corpus_path)
    assert not R.is_finance(docs) and not R.is_finance(docs.select("doc_id"))
    assert R.is_finance(spark.createDataFrame([("a", "ACME")], "doc_id string, ticker string"))


def test_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "deep" / "annual_report.txt").write_text("x" * 60_000)
    (folder / "blank.md").write_text(" \n")
    (folder / "rows.csv").write_text('_id,text,ticker\n1,"two\nlines, ""quoted""",ACME\n,named by its text,\n2,,T\n')
    (folder / "raw.csv").write_text("a,b\n1,2\n")
    (folder / "broken.pdf").write_bytes(b"no pdf")
    (folder / "other.bin").write_bytes(b"x")
    got = {r.title: r for r in R.ingest(spark, str(folder), R.Defaults(period="2024-Q1")).collect() if r._id not in ("1",)}
    rows = {r._id: r for r in R.ingest(spark, str(folder)).collect()}
    assert rows["1"].text == 'two\nlines, "quoted"' and rows["1"].ticker == "ACME" and "2" not in rows and len(rows) == 4
    assert set(got) == {"Annual Report", "Raw", "rows.csv"}
    assert len(got["Annual Report"].text) == R.FILE_CHARS and got["Annual Report"].period == "2024-Q1"
    assert got["rows.csv"].ticker == "UNKNOWN" and got["rows.csv"]._id.startswith("FIN_")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456789), ("b", 1.0)], "name string, v double").coalesce(1)
    for append in (False, True):
        sinks.write_jsonl(df, str(tmp_path / "j"), append)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().v == "0.12346"
    assert sinks.markdown(df) == "| name | v |\n| --- | --- |\n| a | 0.1235 |\n| b | 1.0 |\n"
    assert sinks.bar_chart(df, "name", ["v"], "t & u", 0.5).count("<rect") == 2


@pytest.fixture(scope="module")
def engine(spark, corpus_path):
    return N.Engine(N.build(R.read_corpus(spark, corpus_path), IndexConfig(champions=2)))


def test_requests(engine):
    got = {o: respond(engine, o, {"query": "red fox", "term": "fox", "claim": "The red fox runs", "explain": True}) for o in OPERATIONS}
    assert json.loads(json.dumps(got)) == got
    assert got["stats"]["n_docs"] == 2
    assert got["search"]["hits"][0]["parent_doc"] == "a" and got["search"]["trace"]["query_terms"] == ["red", "fox"]
    assert got["term"]["df"] >= 1 and got["term"]["postings"][0]["tf"] >= 1
    assert got["bool"]["n_results"] == len(got["bool"]["hits"]) >= 1
    assert got["verify"]["verdict"] in ("SUPPORTED", "WEAK", "UNSUPPORTED") and got["verify"]["rows"][0]["rank"] == 1
    assert got["ask"]["retrieved"] and got["ask"]["disclaimer"] is None and sum(got["ask"]["verdicts"].values()) == len(got["ask"]["verification"])
    assert respond(engine, "search", {"query": "unknownword"})["hits"] == []
    assert engine.term("unknownword") == {"term": "unknownword", "df": 0, "idf": 0.0, "postings": [], "skips": [], "champions": []}
    with pytest.raises(KeyError):
        respond(engine, "other", {})


def test_outside_generator(engine):
    said = engine.ask("red fox", generate=lambda prompt: "The red fox runs [1]. Fish swim [9].")
    assert [(r["claim"], r["citations"]) for r in said["verification"]] == [("The red fox runs.", [1]), ("Fish swim.", [1])]
    assert said["generator"] == "llm"


def test_http(engine):
    import threading
    import urllib.error
    import urllib.request

    s = server(engine, port=18123)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def post(path, body):
        try:
            with urllib.request.urlopen(urllib.request.Request("http://127.0.0.1:%d%s" % (s.server_address[1], path), body.encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert post("/api/bool", '{"query": "fox"}')[1]["n_results"] >= 1
        assert [post(p, b)[0] for p, b in (("/api/x", "{}"), ("/api/bool", "{"), ("/api/bool", "{}"))] == [404, 400, 500]
    finally:
        s.shutdown()
        s.server_close()


def test_command_line(spark, tmp_path, corpus_path, capsys):
    where = str(tmp_path / "index")
    main(["build", corpus_path, "--index", where, "--champions", "5"])
    capsys.readouterr()
    main(["bool", "cold AND fish", "--index", where])
    assert json.loads(capsys.readouterr().out)["hits"][0]["parent_doc"] == "b"
    repl(N.Engine.load(spark, where), ["k 1", "s cold rivers", "q", "s never"])
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 1
    a = parser().parse_args(["search", "x", "--method", "bm25", "--k", "3"])
    assert search_config(vars(a), 10).method == "bm25" and search_config(vars(a), 10).k == 3


def test_evaluation_commands(spark, tmp_path, corpus_path, capsys):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"_id": str(i), "text": t, "metadata": {"a": [{"sentences": [0], "label": "SUPPORT"}]}}) for i, t in enumerate(["red fox runs", "the fox likes rivers"])))
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n0\ta\t1\n1\ta\t1\n")
    main(["eval", corpus_path, str(tmp_path / "q.jsonl"), str(tmp_path / "q.tsv"), "--out", str(tmp_path / "e")])
    assert capsys.readouterr().out.count("\n| ") == 9
    main(["build", corpus_path, "--index", str(tmp_path / "i")])
    main(["eval-verify", str(tmp_path / "q.jsonl"), str(tmp_path / "q.tsv"), "--index", str(tmp_path / "i"), "--out", str(tmp_path / "v")])
    assert "jaccard" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "tables")
    folder.mkdir()
    (folder / "1.json").write_text('{"_id":"a","title":"fox","text":"A red fox."}\n{"_id":"b","title":"","text":"A fish."}')

    def run():
        index_stream(corpus_stream(spark, str(folder)), target, str(tmp_path / "checkpoint")).awaitTermination()
        return open_index(spark, target, IndexConfig())

    assert run().n == 2
    (folder / "2.json").write_text('{"_id":"a","title":"wolf","text":"A grey wolf."}')
    again = run()
    assert again.n == 2 and {r.term for r in again.term_stats.select("term").collect()} == {"wolf", "grei", "fish"}
