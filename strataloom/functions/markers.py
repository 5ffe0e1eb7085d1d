"""What a line of source declares: suppressions, and the packages it imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suppression markers, the first that is declared names the line.
SUPPRESSIONS = [
    (r"#\s*noqa\b", "noqa"),
    (r"#\s*type:\s*ignore\b", "type: ignore"),
    (r"#\s*pragma:\s*no\s*cover\b", "pragma: no cover"),
    (r"#\s*nosec\b", "nosec"),
    (r"//\s*eslint-disable", "eslint-disable"),
    (r"/\*\s*eslint-disable", "eslint-disable"),
    (r"//\s*@ts-(ignore|expect-error)\b", "ts-ignore"),
    (r"@SuppressWarnings\b", "SuppressWarnings"),
    (r"//\s*NOSONAR\b", "NOSONAR"),
    (r"#\s*pylint:\s*disable\b", "pylint: disable"),
    (r"@pytest\.mark\.(skip|skipif|xfail)\b", "skipped test"),
    (r"@unittest\.skip(If|Unless)?\b", "skipped test"),
    (r"\bit\.skip\(|\bdescribe\.skip\(", "skipped test"),
    (r"@Disabled\b", "disabled test"),
    (r"@Ignore\b", "ignored test"),
]

# Libraries that serve one concern, of which a code base needs one.
CONCERNS = {
    "http client": ["requests", "httpx", "aiohttp", "urllib3", "axios", "got", "superagent", "node-fetch", "ky"],
    "date handling": ["moment", "dayjs", "date-fns", "luxon", "arrow", "pendulum"],
    "client state": ["redux", "@reduxjs/toolkit", "zustand", "jotai", "recoil", "mobx", "valtio"],
    "schema validation": ["zod", "yup", "joi", "ajv", "superstruct", "pydantic", "marshmallow", "cerberus", "voluptuous"],
    "orm": ["sqlalchemy", "peewee", "tortoise", "prisma", "typeorm", "sequelize", "drizzle-orm", "knex"],
    "web framework": ["flask", "fastapi", "bottle", "sanic", "express", "koa", "fastify", "hapi"],
}


def competing(uses: DataFrame, concerns: dict[str, list[str]] = CONCERNS) -> DataFrame:
    """``uses`` (path, package) of the packages that serve a concern, with it."""
    served = F.create_map(*[F.lit(x) for concern, own in concerns.items() for package in own for x in (package, concern)])
    return uses.withColumn("concern", F.try_element_at(served, F.col("package"))).filter(F.col("concern").isNotNull())


def suppression(text: Column) -> Column:
    """The marker that a line declares. One that follows a quote, or an odd number of backticks, is only mentioned."""
    out = None
    for pattern, label in SUPPRESSIONS:
        before = F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern})", 1)
        used = text.rlike(f"(?i)(?:{pattern})") & ~before.rlike("[`'\"]$") & (F.length(F.regexp_replace(before, "[^`]", "")) % 2 == 0)
        out = F.when(used, label) if out is None else out.when(used, label)
    return out


def root_package(module: Column) -> Column:
    """The package a module path belongs to, scope included; null for relative ones."""
    own = F.lower(F.trim(module))
    scoped = F.array_join(F.slice(F.split(own, "/"), 1, 2), "/")
    root = F.when(own.startswith("."), None).when(own.startswith("@"), scoped).otherwise(F.split_part(F.split_part(own, F.lit("/"), F.lit(1)), F.lit("."), F.lit(1)))
    return F.when(root != "", root)


def imported(line: Column, python: Column) -> Column:
    """Array of the packages that a line imports: ``import`` and ``from`` in Python, else quoted names after from, import or require."""
    of_python = F.array(F.regexp_extract(line, r"^\s*(?:import|from)\s+([\w.]+)", 1))
    others = F.regexp_extract_all(line, F.lit(r"""(?:\bfrom|\bimport|\brequire\(|\bimport\()\s*['"]([^'"]+)['"]"""), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(F.when(python, of_python).otherwise(others), root_package)))
