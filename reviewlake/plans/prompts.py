"""Prompts of a batch of requests, one table per stage.

The answers come back from outside as responses(run, stage, attempt, text, ...)
and go through ``validation.check_response`` and ``timing.first_valid_attempt``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import schemas as S
from reviewlake.functions.json_text import json_of
from reviewlake.functions.text import number_lines, render_template

# Stage and the template it uses.
TEMPLATES = {"analyze": "analyzer", "fix": "fixer", "test": "tester", "report": "reporter"}


def stage_values(stage: str) -> dict[str, Column]:
    """What a stage's template is filled with.

    Columns: language and code of the request, and the answers of the stages
    before it as ``analysis``, ``fix`` and ``tests``.
    """
    code = F.col("code")
    if stage == "analyze":
        return {"language": F.col("language"), "code_input": number_lines(code)}
    analysis = json_of("analysis", S.ANALYSIS, 0)
    if stage == "fix":
        return {"language": F.col("language"), "code_input": code, "analysis_json": analysis}
    if stage == "test":
        return {"language": F.col("language"), "fixed_code": F.col("fix.fixedCode"), "analysis_json": analysis}
    return {
        "analysis_json": analysis,
        "fixes_json": json_of("fix.fixes", f"array<{S.FIX_ITEM}>", 0),
        "test_count": F.size("tests.cases").cast("string"),
    }


def stage_prompts(rows: DataFrame, templates: DataFrame, stage: str) -> DataFrame:
    """Rows with the ``prompt`` of one stage; its template is read once, as a scalar."""
    named = templates.filter(F.col("name") == TEMPLATES[stage])
    template = named.groupBy().agg(F.max("template")).scalar()
    values = F.create_map(*[x for k, v in stage_values(stage).items() for x in (F.lit(k), v)])
    return (
        rows.withColumn("_template", template)
        .withColumn("prompt", render_template("_template", values))
        .drop("_template")
    )
