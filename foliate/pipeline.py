"""The whole run: pages to verdicts, cards, instances, order, and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.operators import cards, classify, grouping, ordering, provider
from foliate.plans import prompts
from foliate.plans.policies import POLICIES
from foliate.plans.policy import Policy
from foliate.sources.tables import materialise


class Run(NamedTuple):
    verdicts: DataFrame
    cards: DataFrame
    instances: DataFrame
    ordering: DataFrame
    unresolved: DataFrame


class Models(NamedTuple):
    """Model calls: ``text`` takes a prompt, ``vision`` a prompt and an image; both return (JSON, prompt tokens, completion tokens)."""

    cache: str
    text: Callable | None = None
    vision: Callable | None = None
    name: str = "model"


def ask_text(pages: DataFrame, verdicts: DataFrame, policies: Sequence[Policy], models: Models, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Answers (package, page, answer_type, answer_subtype) for pages that the rules deferred, and the calls."""
    keys = ["package", "page"]
    scored = materialise(classify.scores(pages, policies, keys, fuzzy=fuzzy), "scores")  # a filter on their columns would spell them out again
    inputs = classify.model_inputs(verdicts, scored, policies, keys)
    inputs = inputs.join(pages.select(*keys, F.col("raw").alias("page_text")), keys)
    names = ["candidate_types", "reason", "signal_summary", "subtype_options", "page_text"]
    prompt = provider.render(prompts.CLASSIFY, {n: F.col(n) for n in names})
    requests = inputs.select(*keys, prompt.alias("prompt")).withColumn("key", provider.cache_key(prompts.CLASSIFY, models.name, F.col("prompt")))
    rows, calls = provider.answered(materialise(requests, "text-requests"), models.cache, models.text, models.name)
    return rows.select(*keys, *_answer()), calls.withColumn("stage", F.lit("classify_page"))


def ask_vision(images: DataFrame, verdicts: DataFrame, policies: Sequence[Policy], models: Models) -> tuple[DataFrame, DataFrame]:
    """Answers for pages without text, from (package, page, image), with what the model read off them, and the calls."""
    keys = ["package", "page"]
    types = "\n".join(f"- {t}" for t in [*sorted(p.type for p in policies), "OTHER"])
    due = verdicts.filter("rule_grade = 'DEFER_VLM'").select(*keys).join(images, keys)
    prompt = provider.render(prompts.CLASSIFY_IMAGE, {"candidate_types": F.lit(types), "package": F.col("package"), "page": F.col("page")})
    requests = due.select(*keys, "image", prompt.alias("prompt"))
    requests = requests.withColumn("key", provider.cache_key(prompts.CLASSIFY_IMAGE, models.name, F.col("prompt"), F.sha2("image", 256)))
    rows, calls = provider.answered(materialise(requests, "vision-requests"), models.cache, models.vision, models.name)
    read = [F.get_json_object("parsed", f"$.extracted.{c}").alias(c) for c in ("page_marker", "form_code", "vendor")]
    return rows.select(*keys, *_answer(), *read), calls.withColumn("stage", F.lit("classify_page_vision"))


def _answer() -> list[Column]:
    return [F.get_json_object("parsed", "$.type").alias("answer_type"), F.get_json_object("parsed", "$.subtype").alias("answer_subtype")]


def run(
    pages: DataFrame, policies: Sequence[Policy] = POLICIES, answers: DataFrame | None = None, vision: DataFrame | None = None, group: Callable | None = None, fuzzy: bool = True,
    models: Models | None = None, images: DataFrame | None = None, unresolved: DataFrame | None = None,
) -> Run:
    """Pages (package, page, raw) through rules, model answers if any, cards, grouping if there is a provider, and ordering.

    ``answers`` and ``vision``: (package, page, answer_type, answer_subtype); vision also page_marker, form_code, vendor.  With
    ``models`` they are asked for, the images of pages without text being given as (package, page, image).  ``unresolved``:
    (package, type, page) that the grouping names as such; pages that it leaves out are added to them.
    """
    keys, types = ["package", "page"], [p.type for p in policies]
    verdicts = materialise(classify.unified(pages, policies, keys, fuzzy=fuzzy), "verdicts")
    if models and models.text:
        answers, _ = ask_text(pages, verdicts, policies, models, fuzzy)
    if models and models.vision and images is not None:
        vision, _ = ask_vision(images, verdicts, policies, models)
        vision = materialise(vision, "vision-answers")
    if answers is not None:
        verdicts = classify.fold_answers(verdicts, answers, types, keys, "llm")
    if vision is not None:
        verdicts = classify.fold_answers(verdicts, vision, types, keys, "vlm")
    if answers is not None or vision is not None:
        verdicts = materialise(verdicts, "folded-verdicts")
    typed = pages.join(verdicts.select(*keys, "type", "subtype").filter("type is not null"), keys)
    every = [cards.build(typed.filter(F.col("type") == p.type), p, [*keys, "type"], fuzzy=fuzzy) for p in policies]
    if vision is not None:
        every = [cards.fold_vision(c, vision, keys) for c in every]
    made = materialise(reduce(DataFrame.unionByName, every), "cards")
    instances = materialise(grouping.group_by_model(made, group), "instances")
    open_ = made.limit(0) if unresolved is None else unresolved
    known, left = grouping.settle(instances.select("package", "type", "instance_id", "pos", "page"), made, open_, ["package", "type"], "page")
    placed = materialise(known.join(made, ["package", "type", "page"]), "placed-cards")
    ordered = [ordering.order(placed.filter(F.col("type") == p.type), p.order, ["package", "type", "instance_id"]) for p in policies]
    return Run(verdicts, made, placed.select("package", "type", "instance_id", "pos", "page"), reduce(DataFrame.unionByName, ordered), left)
