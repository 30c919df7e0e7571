"""User callbacks: Python functions that extend prompts or judge texts, run as Arrow UDFs.

The functions are loaded on the driver, each in a module of its own, and travel with the task. They have to be free of
side effects: Spark may call one for a row that an earlier step rejected, or call it again when a task is retried.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "post_validation_callback_error"


@dataclass(frozen=True)
class CallbackSpec:
    path: str
    function: str


@lru_cache(maxsize=None)
def load(spec: CallbackSpec) -> Callable:
    """The function; every (file, function) has its own module, so two functions of a file share no globals."""
    path = os.path.abspath(spec.path)
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    name = "callback_" + hashlib.sha1(f"{path}:{spec.function}".encode()).hexdigest()
    known = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(known)
    sys.modules[name] = module
    known.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)
    found = getattr(module, spec.function, None)
    if found is None:
        raise AttributeError(f"{path} has no {spec.function}")
    if not callable(found):
        raise TypeError(f"{spec.function} of {path} is not callable")
    return found


def extend_prompt(functions: list[Callable]) -> Callable[[str | None], tuple[str | None, str | None]]:
    """Each function's prompt goes to the next; two different anchors, or a wrong type, raise TypeError."""

    def run(prompt: str | None) -> tuple[str | None, str | None]:
        anchor = None
        for f in functions:
            got = f(prompt)
            if isinstance(got, tuple):
                if len(got) != 2 or not isinstance(got[0], str) or not (got[1] is None or isinstance(got[1], str)):
                    raise TypeError("a prompt callback returns str or (str, str or None)")
                prompt, own = got
                if own is not None:
                    if anchor is not None and own != anchor:
                        raise TypeError("prompt callbacks gave two anchors")
                    anchor = own
            elif isinstance(got, str):
                prompt = got
            else:
                raise TypeError("a prompt callback returns str or (str, str or None)")
        return prompt, anchor

    return run


def with_extended_prompt(df: DataFrame, functions: list[Callable], prompt: str = "user_prompt") -> DataFrame:
    """Adds user_prompt_after_callbacks and callback_anchor. An exception fails the query."""
    if not functions:
        return df.withColumn("user_prompt_after_callbacks", F.col(prompt)).withColumn("callback_anchor", F.lit(None).cast("string"))
    call = F.udf(extend_prompt(functions), "struct<prompt:string,anchor:string>", useArrow=True)
    return df.withColumn("_x", call(prompt)).withColumn("user_prompt_after_callbacks", F.col("_x.prompt")).withColumn("callback_anchor", F.col("_x.anchor")).drop("_x")


def judge(functions: list[Callable]) -> Callable[[str | None, str | None], tuple[bool, str | None, str | None]]:
    """(accepted, reason, error) by the first rejection; an exception or a result that isn't (bool, str) is an error."""

    def run(text: str | None, anchor: str | None) -> tuple[bool, str | None, str | None]:
        for f in functions:
            try:
                got = f(text, anchor) if anchor is not None else f(text)
                if not (isinstance(got, tuple) and len(got) == 2 and isinstance(got[0], bool) and isinstance(got[1], str)):
                    raise TypeError("a validation callback returns (bool, str)")
            except Exception as e:  # noqa: BLE001 - any failure of user code is a verdict
                return False, ERROR, f"{type(e).__name__}: {e}"
            if not got[0]:
                return False, f"post_validation:{got[1] or 'post_validation_rejected'}", None
        return True, None, None

    return run


def post_validation(functions: list[Callable], text: Column, anchor: Column | None = None) -> Column:
    """struct<accepted, reason, error> of each text."""
    if not functions:
        return F.struct(F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"))
    call = F.udf(judge(functions), "struct<accepted:boolean,reason:string,error:string>", useArrow=True)
    return call(text, F.lit(None).cast("string") if anchor is None else anchor)


def anchored_by_table(df: DataFrame, cases: DataFrame, anchor: str = "callback_anchor", key: str = "case_id", order: str = "case_order") -> DataFrame:
    """``df`` plus ``case``, the struct of its anchor's case, null where there is none; of several cases with a key the one with the greatest ``order`` wins."""
    last = cases.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*cases.columns), F.col(order)).alias("case"))
    return df.join(last, F.col(anchor) == F.col("_key"), "left").drop("_key")
