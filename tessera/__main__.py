"""python -m tessera build|ingest|search|term|bool|ask|verify|eval|eval-verify|repl|web; see --help of each."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import engine as N
from tessera.operators import evaluate as E
from tessera.operators import search as S
from tessera.operators import tuning as T
from tessera.operators import verifier_eval as VE
from tessera.operators import verify as V
from tessera.plans.config import AnalyzerConfig, IndexConfig, SearchConfig, VerifyConfig
from tessera.plans.shipping import ship
from tessera.plans.storage import written
from tessera.server import respond, server
from tessera.sources import sinks
from tessera.sources.readers import Defaults, ingest, read_corpus, read_qrels, read_queries


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, index: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        if index:
            p.add_argument("--index", default="output/index")
        return p

    def searching(p: argparse.ArgumentParser, k: int) -> None:
        p.add_argument("--k", type=int, default=k)
        p.add_argument("--method", choices=("tfidf", "bm25"), default="tfidf")
        p.add_argument("--champions", action="store_true")
        for name, kind, default in (("--proximity", float, 0.5), ("--prox-window", int, 30), ("--static", float, 0.0), ("--eliminate", float, 1.0)):
            p.add_argument(name, type=kind, default=default)

    def checking(p: argparse.ArgumentParser, d: VerifyConfig) -> None:
        p.add_argument("--high", type=float, default=d.high)
        p.add_argument("--low", type=float, default=d.low)
        p.add_argument("--novelty-weight", type=float, default=d.novelty_weight)

    p = command("build", "corpus")
    p.add_argument("--strategy", choices=("whole", "sentence", "fixed", "finance"))
    for name, kind, default in (("--sentences", int, 3), ("--step", int, 2), ("--size", int, 120), ("--overlap", int, 30), ("--zone-weight", float, 2.0), ("--champions", int, 0)):
        p.add_argument(name, type=kind, default=default)
    for name in ("--no-stemming", "--keep-stopwords", "--drop-negators", "--finance"):
        p.add_argument(name, action="store_true")
    p = command("ingest", "folder", "out", index=False)
    for m in ("ticker", "company", "filing-type", "period", "source-url"):
        p.add_argument(f"--{m}")
    p.add_argument("--append", action="store_true")
    searching(command("search", "query"), 10)
    command("term", "term")
    command("bool", "query").add_argument("--limit", type=int, default=10)
    p = command("ask", "query")
    searching(p, 5)
    checking(p, N.ASK)
    p.add_argument("--sentences", type=int, default=3)
    p.add_argument("--explain", action="store_true")
    p = command("verify", "claim")
    p.add_argument("--k", type=int, default=5)
    checking(p, VerifyConfig())
    command("eval", "corpus", "queries", "qrels", index=False).add_argument("--out", default="output/eval_retrieval")
    p = command("eval-verify", "queries", "qrels")
    p.add_argument("--out", default="output/eval_verifier")
    command("repl")
    p = command("web")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8123)
    checking(p, VerifyConfig())
    return top


def _show(value: dict) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=1, default=str))


def _checks(a: argparse.Namespace) -> VerifyConfig:
    return VerifyConfig(a.high, a.low, a.novelty_weight) if hasattr(a, "high") else VerifyConfig()


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = read_corpus(spark, a.corpus)
    finance = a.finance or a.strategy == "finance" or (a.strategy is None and N.is_finance(docs))
    analyzer = AnalyzerConfig(not a.no_stemming, not a.keep_stopwords, not a.drop_negators, finance)
    strategy = a.strategy or ("finance" if finance else "sentence")
    index = N.build(docs, IndexConfig(analyzer, strategy, a.sentences, a.step, a.size, a.overlap, a.zone_weight, a.champions))
    index.save(a.index)
    _show(N.Engine(index).stats())


def _eval(spark: SparkSession, a: argparse.Namespace) -> None:
    """Proximity tuned on the dev queries, the ladder measured on the test queries, or on the dev ones where there are no others."""
    docs, queries, qrels = read_corpus(spark, a.corpus), read_queries(spark, a.queries), read_qrels(spark, a.qrels)
    parts = written(E.split_qids(qrels.select("qid").distinct()), "parts")
    part = lambda df, p: df.join(parts.filter(F.col("part") == p).select("qid"), "qid", "left_semi")
    best = T.best_setting(T.proximity_grid(N.build(docs), part(queries, "dev"), part(qrels, "dev"))).first()
    asked = "test" if part(qrels, "test").limit(1).count() else "dev"
    table = written(T.ablation(docs, part(queries, asked), part(qrels, asked), setting=(best.weight, best.window, best.prior)), "ablation")
    sinks.write_csv(table, f"{a.out}_csv")
    sinks.write_text(spark, sinks.bar_chart(table, "configuration", ["ndcg", "p10", "r100"], f"Retrieval on the {asked} queries"), f"{a.out}_svg")
    print(sinks.markdown(table))


def _eval_verify(spark: SparkSession, a: argparse.Namespace) -> None:
    index = N.Engine.load(spark, a.index).index
    qrels = read_qrels(spark, a.qrels)
    judged = qrels.select("qid").distinct()
    queries = read_queries(spark, a.queries).join(judged, "qid", "left_semi")
    evidence = VE.evidence_of(queries)
    items = written(VE.items(queries, evidence), "items")
    ranked = written(S.search(index, queries, SearchConfig()), "ranked")
    parts = written(E.split_qids(judged, 100), "parts")
    scored = written(VE.scores(index, items, ranked), "scored")
    table = written(VE.report(scored, parts), "report")
    sinks.write_csv(table, f"{a.out}_csv")
    bins = VE.histogram(scored.join(parts.filter("part = 'test'").select("qid"), "qid", "left_semi")).groupBy("bin").pivot("label", ["SUPPORT", "CONTRADICT", "NEI"]).sum("n").orderBy("bin")
    all_bins = spark.range(25).withColumnRenamed("id", "bin").join(bins, "bin", "left").fillna(0).orderBy("bin")
    threshold = table.filter("method = 'cosine'").first().threshold
    sinks.write_text(spark, sinks.bar_chart(all_bins, "bin", ["SUPPORT", "CONTRADICT", "NEI"], "Cosine by label, and its threshold", at=threshold), f"{a.out}_svg")
    print(sinks.markdown(table))
    test = items.join(parts.filter("part = 'test'").select("qid"), "qid", "left_semi")
    print(sinks.markdown(VE.hit_at_k(index, test, ranked)))
    best = ranked.filter("rank <= 5")
    print(sinks.markdown(VE.evidence_recall(index, test, evidence, best, V.answer(index, best, queries))))


def repl(engine: N.Engine, lines) -> None:
    """Lines `s|b|t|v|a text` search, match, describe, verify, ask; `k N`, `sents N`, `explain on|off` set, `q` ends."""
    verbs, fields = {"s": "search", "b": "bool", "t": "term", "v": "verify", "a": "ask"}, {"t": "term", "v": "claim"}
    settings = {"k": 5, "sentences": 3, "explain": False}
    for line in lines:
        verb, _, rest = line.strip().partition(" ")
        if verb in ("q", "quit", "exit"):
            return
        if verb in ("k", "sents") and rest.isdigit():
            settings["k" if verb == "k" else "sentences"] = int(rest)
        elif verb == "explain":
            settings["explain"] = rest == "on"
        elif verb in verbs and rest:
            _show(respond(engine, verbs[verb], settings | {fields.get(verb, "query"): rest}))
        elif verb:
            print(repl.__doc__)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    if a.command == "build":
        return _build(spark, a)
    if a.command == "ingest":
        given = {m: v for m in Defaults.__dataclass_fields__ if (v := getattr(a, m))}
        return sinks.write_jsonl(ingest(spark, a.folder, Defaults(**given)), a.out, a.append)
    if a.command == "eval":
        return _eval(spark, a)
    if a.command == "eval-verify":
        return _eval_verify(spark, a)
    engine = N.Engine.load(spark, a.index)
    if a.command == "web":
        s = server(engine, a.host, a.port, _checks(a))
        print("http://%s:%d" % s.server_address[:2])
        return s.serve_forever()
    if a.command == "repl":
        return repl(engine, iter(lambda: input("> "), "q"))
    _show(respond(engine, a.command, {k: v for k, v in vars(a).items() if v is not None}, _checks(a)))


if __name__ == "__main__":
    main()
