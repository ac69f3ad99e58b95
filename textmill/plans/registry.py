"""All queries of the engine's own operators, by name, and the SQL that must give the same rows."""

from __future__ import annotations

import re

from textmill.functions.dialect import Duck, Spark
from textmill.operators import audits, control, corpus, dedup, exact, models, packing, text
from textmill.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TEXTS = text.QUERIES | corpus.QUERIES | control.QUERIES | models.QUERIES | packing.QUERIES | audits.QUERIES | dedup.QUERIES


def _query(build):
    sql = build(Spark)
    used = [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)]

    def run(spark, sf_dir):
        plan = sql
        for t in used:
            view = f"{t}_{abs(hash(str(sf_dir))) % 10**12}"
            table(spark, sf_dir, t).createOrReplaceTempView(view)
            plan = re.sub(rf"\b(from|join) {t}\b", rf"\1 {view} {t}" if re.search(rf"\b{t}\.", sql) else rf"\1 {view}", plan)
        return spark.sql(plan)

    return run


QUERIES = {name: _query(build) for name, build in _TEXTS.items()} | packing.DIRECT | dedup.DIRECT | exact.DIRECT
ORACLES = {name: build(Duck) for name, build in _TEXTS.items()} | dedup.ORACLES | exact.ORACLES
