"""Command line: the stages over a folder of parquet tables.

    python -m kgloom.cli list
    python -m kgloom.cli run QUERY --tables FOLDER --out FOLDER [--format parquet|jsonl|csv]
    python -m kgloom.cli structured init-db|build|validate|export-csv --root FOLDER [--tables FOLDER] [--out FOLDER]
    python -m kgloom.cli unstructured preprocess --pages FOLDER --out FOLDER [--strict]
    python -m kgloom.cli mentions prepare|weak-label|train|predict ...
    python -m kgloom.cli linking link|mine-gaps|evaluate, coreference resolve,
        relations prepare|weak-label|train|predict|evaluate, facts generate-candidates|score|verify-llm|aggregate|run,
        events extract|to-facts, visualization export --tables FOLDER --out FOLDER

Every stage writes a folder and, beside it, a summary of its rows. `graph`, `preprocess` and
`validate` are short names of visualization export, unstructured preprocess and a check of tables.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import local_session, table

#: Stages that are one query over the tables: (group, command) -> query, column that the summary counts by.
STAGES = {
    ("linking", "link"): ("link_decisions", "decision"), ("linking", "mine-gaps"): ("link_gaps", "priority"), ("linking", "evaluate"): ("linking_eval", None), ("coreference", "resolve"): ("coref_resolve", "reason"),
    ("relations", "prepare"): ("mention_pairs", "relations"), ("relations", "weak-label"): ("weak_labels", "label"), ("relations", "predict"): ("masked_predictions", "relation"), ("relations", "evaluate"): ("relation_prf", None),
    ("facts", "generate-candidates"): ("event_fact_candidates", "predicate"), ("facts", "score"): ("distant_support", "n_claims"), ("facts", "verify-llm"): ("fact_verdicts", "verdict"), ("facts", "aggregate"): ("fact_aggregate", "status"),
    ("facts", "run"): ("whole_facts", "status"), ("events", "extract"): ("text_events", "event_type"), ("events", "to-facts"): ("event_facts", "predicate"),
}
OTHERS = {"structured": ("init-db", "build", "validate", "export-csv"), "unstructured": ("preprocess",), "mentions": ("prepare", "weak-label", "train", "predict"), "relations": ("train",), "visualization": ("export",)}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--format", choices=("parquet", "jsonl", "csv"), default="parquet")
    graph, pre, val = sub.add_parser("graph"), sub.add_parser("preprocess"), sub.add_parser("validate")
    for s in (run, graph, val):
        s.add_argument("--tables", required=True)
    for s in (run, graph, pre):
        s.add_argument("--out", required=True)
    pre.add_argument("--pages", required=True)
    pre.add_argument("--strict", action="store_true")
    groups: dict[str, list[str]] = {g: list(c) for g, c in OTHERS.items()}
    for g, c in STAGES:
        groups.setdefault(g, []).append(c)
    for g, commands in groups.items():
        inner = sub.add_parser(g).add_subparsers(dest="stage", required=True)
        for c in commands:
            s = inner.add_parser(c)
            s.add_argument("--out", required=(g, c) not in (("structured", "init-db"), ("structured", "build"), ("structured", "validate")))
            s.add_argument("--tables", required=g not in ("structured", "unstructured"))
            s.add_argument("--format", choices=("parquet", "jsonl", "csv"), default="parquet")
            if g == "structured":
                s.add_argument("--root", required=True)
            elif g == "unstructured":
                s.add_argument("--pages", required=True)
                s.add_argument("--strict", action="store_true")
            elif g == "mentions":
                s.add_argument("--labeled")
                s.add_argument("--model")
                s.add_argument("--sample-size", type=int, default=120)
                s.add_argument("--dev-ratio", type=float, default=0.2)
                s.add_argument("--seed", type=int, default=42)
    return p


def write(df: DataFrame, out: str, form: str = "parquet", by: str | None = None) -> dict:
    """Writes a result in parallel and its summary beside it; the summary."""
    from kgloom.sources import files

    if form == "parquet":
        df.write.mode("overwrite").parquet(out)
        done = df.sparkSession.read.parquet(out)
    elif form == "jsonl":
        files.write_jsonl(df, out)
        done = df
    else:
        files.write_csv(df, out, df.columns)
        done = df
    summary: dict = {"rows": done.count()}
    if by:  # a few values
        summary[by] = {str(r[by]): r["count"] for r in done.groupBy(by).count().orderBy(F.desc("count"), by).limit(100).collect()}
    if "://" not in out:
        files.write_json(out.rstrip("/") + ".summary.json", summary)
    return summary


def export_graph(spark: SparkSession, tables: str, out: str) -> None:
    from kgloom.operators import graph
    from kgloom.plans.kg_queries import _edges, _nodes
    from kgloom.session import durable
    from kgloom.sources import files

    edges = durable(_edges(spark, tables))
    nodes = durable(graph.placeholder_nodes(_nodes(spark, tables), edges))
    for name, df in zip(("nodes", "edges"), files.gephi_tables(nodes, edges)):
        files.write_csv(df, f"{out}/gephi/{name}", df.columns)
    for name, df in zip(("nodes", "relationships"), files.neo4j_tables(nodes, edges)):
        files.write_csv(df, f"{out}/neo4j/{name}", df.columns)
    files.graph_json(nodes, edges, f"{out}/json")
    top = graph.degrees(edges).orderBy(F.desc("degree"), "id").limit(1).collect()
    labels = [r[0] for r in nodes.select(graph.clean_type(F.col("type"))).distinct().collect()]
    texts = {"load.cypher": files.neo4j_script(nodes, edges), "browser_queries.cypher": files.browser_queries(top[0].id if top else ""), "browser_style.grass": files.browser_style(labels)}
    for name, text in texts.items():
        with open(f"{out}/neo4j/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    files.html_page(nodes, edges, f"{out}/graph.html")


def preprocess(spark: SparkSession, pages: str, out: str, strict: bool = False) -> None:
    """Documents and sentences of a folder of pages; pages of a kind that isn't read go to errors/, or end the run if strict."""
    from kgloom.functions import splitter
    from kgloom.sources import files

    docs = files.extract(files.read_pages(spark, pages)).select(F.col("path").alias("doc_id"), F.col("text").alias("clean_text"), "error")
    docs.write.mode("overwrite").parquet(f"{out}/extracted")
    docs = spark.read.parquet(f"{out}/extracted")
    bad = docs.filter("error is not null")
    if strict and not bad.isEmpty():
        raise ValueError(f"pages that can't be read: {bad.first().doc_id}")
    write(bad, f"{out}/errors")
    write(docs.filter("error is null").drop("error"), f"{out}/documents")
    write(splitter.split_documents(spark.read.parquet(f"{out}/documents")), f"{out}/sentences")


def structured(spark: SparkSession, a: argparse.Namespace) -> int:
    from kgloom.operators import structured as st
    from kgloom.sources.repository import Repository

    repo = Repository(spark, a.root)
    if a.stage == "init-db":
        print("\n".join(repo.init()))
    elif a.stage == "build":
        repo.init()
        given = {n: table(spark, a.tables, n) for n in ("entities", "aliases", "claims")}
        for n in ("entities", "claims"):
            repo.upsert(n, given[n], ("wikipedia_summary_en",) if n == "entities" else ())
        names = given["aliases"].filter("entity_id is not null and alias is not null").select("entity_id", "alias", "alias_lang", F.col("alias_id").alias("pos")).join(given["entities"].select("entity_id", "canonical_name"), "entity_id")
        repo.replace_aliases(st.alias_records(names.select("entity_id", "canonical_name", "alias", "alias_lang", "pos")))
        events = st.claim_events(repo.table("claims"), repo.table("entities"))
        repo.replace("event_candidates", events.select(F.concat(F.lit("evt_"), F.left(F.sha1(F.concat_ws("|", "claim_id", "event_type")), F.lit(16))).alias("event_candidate_id"), "event_type", "subject_id", "object_id", "location_id", F.col("start").alias("start_time_norm"), F.col("end").alias("end_time_norm"), "claim_id"))
    elif a.stage == "export-csv":
        repo.export_csv(a.out)
    else:
        return _checked(st.validate(repo.table("entities"), repo.table("aliases").withColumn("alias_id", F.col("alias")), repo.table("claims"), repo.table("event_candidates")))
    return 0


def mention_stage(spark: SparkSession, a: argparse.Namespace) -> None:
    from kgloom.functions import text as X
    from kgloom.operators import mentions, model, sampling
    from kgloom.plans import kg_queries as Q

    sentences = Q._t(spark, a.tables, "sentences").filter("text is not null").select("sentence_id", "doc_id", "text", X.tokens(F.col("text")).alias("tokens"))
    if a.stage == "prepare":
        t = sentences.withColumn("spans", X.token_spans(F.col("text"), F.col("tokens")))
        write(t.withColumn("token_spans", F.transform("spans", lambda x: F.array(x["s"], x["e"]))).drop("spans"), f"{a.out}/tokenized", a.format)
        write(sampling.per_group(sentences, "doc_id", "sentence_id", 1, a.seed).transform(lambda d: sampling.hash_sample(d, "sentence_id", a.sample_size, a.seed)), f"{a.out}/gold_template", a.format)
        return
    labeled = spark.read.parquet(a.labeled) if a.labeled else Q._labels(spark, a.tables).select(F.col("candidate_id").alias("sentence_id"), "tokens", "labels")
    if a.stage == "weak-label":
        checked = labeled.withColumn("labels", mentions.legal_bio(F.col("labels"))).withColumn("reasons", mentions.check_labels(F.col("tokens"), F.col("labels")))
        write(checked.filter(F.size("reasons") == 0), f"{a.out}/accepted", a.format)
        write(checked.filter(F.size("reasons") > 0), f"{a.out}/rejected", a.format)
    elif a.stage == "train":
        split = sampling.counted_split(labeled, "sentence_id", a.dev_ratio, a.seed)
        write(split.filter("split = 'dev'"), f"{a.out}/dev", a.format)
        model.save(model.train_labeller(split.filter("split = 'train'").drop("split")), f"{a.out}/model")
    else:
        found = model.label_sequences(model.load(a.model), sentences.select("sentence_id", "tokens"))
        s = sentences.join(found, "sentence_id").withColumn("x", X.token_spans(F.col("text"), F.col("tokens")))
        s = s.withColumn("token_spans", F.transform("x", lambda x: F.array(x["s"], x["e"]))).withColumn("confidences", F.array().cast("array<double>"))
        words = mentions.alias_dictionary(mentions.dictionary_names(table(spark, a.tables, "entities"), table(spark, a.tables, "aliases")))
        write(mentions.decode(s, words), a.out, a.format, "mention_type")


def train_relations(spark: SparkSession, a: argparse.Namespace) -> None:
    from kgloom.operators import model
    from kgloom.plans import kg_queries as Q

    t = Q._t(spark, a.tables, "distant_labeled").filter("tokens is not null")
    rows = t.select(F.transform("tokens", F.lower).alias("words"), F.coalesce(F.try_element_at("positive_predicates", F.lit(1)), F.lit("NA")).alias("label"))
    model.save(model.train_relations(rows), f"{a.out}/model")


def _checked(found: DataFrame) -> int:
    rows = found.groupBy("check", "level").count().collect()
    for r in rows:
        print(r.level, r["check"], r["count"])
    return int(any(r.level == "error" for r in rows))


def main(argv: list[str] | None = None) -> int:
    from kgloom.plans import catalog

    a = build_parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = SparkSession.getActiveSession() or local_session()
    stage = (a.command, getattr(a, "stage", None))
    if a.command == "run":
        write(catalog.queries()[a.query](spark, a.tables), a.out, a.format)
    elif stage in STAGES:
        query, by = STAGES[stage]
        write(catalog.queries()[query](spark, a.tables), a.out, a.format, by)
    elif a.command == "validate":
        return _checked(catalog.queries()["structured_checks"](spark, a.tables))
    elif a.command == "structured":
        return structured(spark, a)
    else:
        handlers: dict[str, Callable] = {"graph": lambda: export_graph(spark, a.tables, a.out), "visualization": lambda: export_graph(spark, a.tables, a.out), "preprocess": lambda: preprocess(spark, a.pages, a.out, a.strict), "unstructured": lambda: preprocess(spark, a.pages, a.out, a.strict), "mentions": lambda: mention_stage(spark, a), "relations": lambda: train_relations(spark, a)}
        handlers[a.command]()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
