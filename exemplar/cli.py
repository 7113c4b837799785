"""Command line front end (``python -m exemplar.cli <command> ...``).

Each command gets or creates the Spark session it is launched in (use
``spark-submit`` on a cluster; its configuration, including
``spark.checkpoint.dir``, is used as is) and runs one job of the library:

  retrieve       index a JSONL corpus (reused when present) and write the
                 retrieved context of every benchmark case as JSON
  prompts        build prompts for a benchmark, optionally with retrieved context
  generate       run a generator given as ``module:function`` over the prompts
  clean          cut the test functions out of generated answers (one file/dir)
  clean-stream   the same for newly arrived answer files only (checkpointed)
  compare        standard vs few-shot comparison reports from summary.json files
  audit          line counts and sizes of retrieval outputs per model/language
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession


def _splits(items: list[str]) -> dict[str, str]:
    out = {}
    for it in items:
        lang, _, path = it.partition("=")
        if not path:
            raise SystemExit(f"expected LANG=PATH, got {it!r}")
        out[lang] = path
    return out


def _session() -> SparkSession:
    from .session import checkpoint_dir, ship_package

    spark = SparkSession.builder.appName("exemplar").getOrCreate()
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def cmd_retrieve(a) -> None:
    from .functions.embedders import HashedEmbedder
    from .plans.retrieval import retrieval_job, write_context
    from .sources.benchmark import read_benchmark
    from .sources.index_store import build_or_load

    spark = _session()
    emb = HashedEmbedder(a.dim)
    index = build_or_load(spark, a.index_dir, a.corpus, emb, a.max_examples)
    if index is None:
        raise SystemExit("no training data loaded")
    bench = read_benchmark(spark, _splits(a.benchmark))
    nested = retrieval_job(
        bench, index, emb, k=a.top_k, threshold=a.threshold, enable_reranking=not a.no_rerank, pool_size=a.pool
    )
    write_context(nested, a.out)


def cmd_prompts(a) -> None:
    from .operators.prompts import build_prompts
    from .sources.benchmark import read_benchmark, read_contexts

    spark = _session()
    bench = read_benchmark(spark, _splits(a.benchmark)).withColumnRenamed("pos", "ordinal_in")
    ctx = read_contexts(spark, a.contexts) if a.contexts else None
    out = build_prompts(
        bench, ctx, instruct=a.instruct, use_fewshot=ctx is not None, is_rag=a.rag,
        file_context=a.file_context, arg_context=a.arg_context,
    )
    out.drop("messages").write.mode("overwrite").json(a.out)


def cmd_generate(a) -> None:
    from .operators.inference import generate_all, save_generations

    spark = _session()
    mod, _, fn = a.generator.partition(":")
    generator = getattr(importlib.import_module(mod), fn)
    prompts = spark.read.json(a.prompts)
    save_generations(generate_all(prompts, generator, n=a.n, concurrency=a.concurrency, pacing=a.pacing), a.out)


def cmd_clean(a) -> None:
    from .operators.responses import clean_file

    clean_file(_session(), a.input, a.out, a.lang)


def cmd_clean_stream(a) -> None:
    from .streaming.incremental import clean_new_files

    clean_new_files(_session(), a.raw, a.out, a.checkpoint, a.lang)


def cmd_compare(a) -> None:
    from .sources.summaries import read_summaries, write_reports

    spark = _session()
    for path in write_reports(read_summaries(spark, a.eval_dir), a.out):
        print(path)


def cmd_audit(a) -> None:
    from .sources.audit import audit_outputs

    audit_outputs(_session(), a.root, a.models, file_name=a.file_name).orderBy("model", "lang").show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="exemplar")
    sub = p.add_subparsers(dest="cmd", required=True)

    r = sub.add_parser("retrieve")
    r.add_argument("--corpus", required=True)
    r.add_argument("--benchmark", nargs="+", required=True, help="LANG=PATH per split")
    r.add_argument("--index-dir", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--top-k", type=int, default=3)
    r.add_argument("--threshold", type=float, default=0.0)
    r.add_argument("--pool", type=int, default=50)
    r.add_argument("--no-rerank", action="store_true")
    r.add_argument("--dim", type=int, default=64)
    r.add_argument("--max-examples", type=int, default=0)
    r.set_defaults(fn=cmd_retrieve)

    pr = sub.add_parser("prompts")
    pr.add_argument("--benchmark", nargs="+", required=True)
    pr.add_argument("--contexts")
    pr.add_argument("--out", required=True)
    pr.add_argument("--instruct", action="store_true")
    pr.add_argument("--rag", action="store_true")
    pr.add_argument("--file-context", action="store_true")
    pr.add_argument("--arg-context", action="store_true")
    pr.set_defaults(fn=cmd_prompts)

    g = sub.add_parser("generate")
    g.add_argument("--prompts", required=True)
    g.add_argument("--generator", required=True, help="module:function taking (prompt, n)")
    g.add_argument("--out", required=True)
    g.add_argument("--n", type=int, default=5)
    g.add_argument("--concurrency", type=int)
    g.add_argument("--pacing", type=float, default=0.0)
    g.set_defaults(fn=cmd_generate)

    c = sub.add_parser("clean")
    c.add_argument("--input", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--lang", required=True)
    c.set_defaults(fn=cmd_clean)

    cs = sub.add_parser("clean-stream")
    cs.add_argument("--raw", required=True)
    cs.add_argument("--out", required=True)
    cs.add_argument("--checkpoint", required=True)
    cs.add_argument("--lang", required=True)
    cs.set_defaults(fn=cmd_clean_stream)

    cmp_ = sub.add_parser("compare")
    cmp_.add_argument("--eval-dir", required=True)
    cmp_.add_argument("--out", required=True)
    cmp_.set_defaults(fn=cmd_compare)

    au = sub.add_parser("audit")
    au.add_argument("--root", required=True)
    au.add_argument("--models", nargs="+", required=True)
    au.add_argument("--file-name", default=None, help="per-language file name (default: the partitioned context layout)")
    au.set_defaults(fn=cmd_audit)

    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])
