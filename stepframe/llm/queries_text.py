"""Registered queries of the operators that run Python in tasks: near-duplicates, scoring, tokens, secrets, leaks."""

from __future__ import annotations

import os

from stepframe.llm.decontaminate import contaminations
from stepframe.llm.dedup import near_duplicates
from stepframe.llm.lattice import lattice_scores
from stepframe.llm.registry import query
from stepframe.llm.secrets import secret_scan
from stepframe.llm.tokens import token_counts


def piece_model() -> str:
    """The 32k piece model of the installed tokenizer files; STEPFRAME_PIECES names another place."""
    import public_tokenizers

    return os.environ.get("STEPFRAME_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


@query("op1_near_duplicates")
def duplicates(table):
    return near_duplicates(table("documents").select("doc_id", "text"))


@query("op4_lattice_scores")
def scores(table):
    return lattice_scores(table("documents").select("doc_id", "text"), piece_model())


@query("op5_token_counts")
def counts(table):
    return token_counts(table("documents").select("doc_id", "text"), piece_model())


@query("op6_secret_scan")
def secrets(table):
    return secret_scan(table("documents").select("doc_id", "text"))


@query("op8_benchmark_leaks")
def leaks(table):
    return contaminations(table("documents").select("doc_id", "text"), table("benchmark"))
