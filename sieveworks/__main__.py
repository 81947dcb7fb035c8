"""The command line.

    python -m sieveworks list
    python -m sieveworks QUERY TABLES [OUTPUT]                     a registered query over a folder of tables
    python -m sieveworks build INDEX KIND=PATH ...                 statutes=, textbooks=, articles=, forum= to an index
    python -m sieveworks search INDEX TEXT [K [METHOD]]            Dense, BM25, Union, RRF or RRF+Rerank
    python -m sieveworks evaluate INDEX SOURCE [N [K]]             the four methods on titles of a source
"""

from __future__ import annotations

import sys

from .operators.providers import hash_encoder
from .plans import corpus
from .plans.jobs import QUERIES
from .session import local_session, ship_package

#: The stand-in model of the command line.
MODEL, DIMENSION = "hash", 64


def main(args: list[str]) -> int:
    if args == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    command, rest = (args[0], args[1:]) if args else ("", [])
    sizes = {"build": range(2, 6), "search": range(2, 5), "evaluate": range(2, 5), **{q: range(1, 3) for q in QUERIES}}
    if len(rest) not in sizes.get(command, ()) or command == "build" and not all("=" in x for x in rest[1:]):
        print(__doc__, file=sys.stderr)
        return 2
    spark = local_session()
    ship_package(spark)
    encode = hash_encoder(DIMENSION)
    if command == "build":
        corpus.build(corpus.sources_from_files(spark, dict(x.split("=", 1) for x in rest[1:])), rest[0], encode, MODEL)
    elif command == "search":
        engine = corpus.load(spark, rest[0], encode)
        k, method = int(rest[2]) if len(rest) > 2 else 5, rest[3] if len(rest) > 3 else "RRF+Rerank"
        hits = engine.retrieve(engine.queries([rest[1]]), k, method).select("chunk_id", "rank")
        hits.join(engine.chunks, "chunk_id").select("rank", "chunk_id", "source", "title", "text").orderBy("rank").show(k, truncate=80)
    elif command == "evaluate":
        numbers = dict(zip(("n", "k"), map(int, rest[2:]), strict=False))
        corpus.evaluate(corpus.load(spark, rest[0], encode), rest[1], **numbers).show(truncate=False)
    else:
        out = QUERIES[command](spark, rest[0])
        out.write.parquet(rest[1]) if len(rest) == 2 else out.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
