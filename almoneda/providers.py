"""What other services would compute: embeddings, OCR, chunks, model answers. Each is a function that is asked in batches on
the executors; those here are deterministic stand-ins that need no network, and `http_model` asks a model server.
"""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almoneda.texts import PCAP_TERMS, PPT_TERMS, prompt_text

DIM, BATCH = 64, 48
#: (texts) -> an answer each, in order.
Provider = Callable[[list[str]], list]


def ask(df: DataFrame, text: str, provider: Provider, out: str, kind: T.DataType | str, batch: int = BATCH) -> DataFrame:
    """df with the provider's answer to each text as last column, asked in batches; order and rows are kept.

    A null text is asked as an empty one.
    """
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    at = df.columns.index(text)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                p = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(provider([t or "" for t in p.column(at).to_pylist()]), arrow)], schema.names)

    return df.mapInArrow(run, schema)


def embed_one(text: str, dim: int = DIM) -> list[float]:
    """Hashed bag of words of length 1; an empty text is all zeros."""
    v = [0.0] * dim
    for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed_batch(texts: list[str]) -> list[list[float]]:
    return [embed_one(t) for t in texts]


def embed(df: DataFrame, text: str = "content", provider: Provider = embed_batch, batch: int = BATCH) -> DataFrame:
    """df with `embedding`."""
    return ask(df, text, provider, "embedding", "array<float>", batch)


def http_model(url: str, model: str, as_json: bool = False, timeout: float = 300, post: Callable[[str, bytes], bytes] | None = None) -> Provider:
    """A provider that posts each prompt to a model server's generate call; an answer that fails is empty."""

    def one(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False} | ({"format": "json"} if as_json else {})).encode()
        try:
            if post:
                return json.loads(post(f"{url}/api/generate", body)).get("response", "")
            request = urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                return json.loads(r.read()).get("response", "")
        except (OSError, ValueError):
            return ""

    return lambda prompts: [one(p) for p in prompts]


def pcap_prompt(text: Column | str) -> Column:
    return F.concat(F.lit("Extract the administrative clauses of this document as one JSON object: penalties, payments, guarantees, solvency, subcontracting.\n\n"), prompt_text(text))


def ppt_prompt(text: Column | str) -> Column:
    return F.concat(F.lit("Extract the technical requirements of this document as one JSON object: deliverables, profiles, certifications, technology, place.\n\n"), F.col(text) if isinstance(text, str) else text)


def criteria_prompt(task: str, criteria: Column, *more: Column) -> Column:
    """One of the tasks `summary`, `risks`, `scoring` and `executive` over criteria as JSON, and over what was extracted."""
    #: What each task asks for.
    asked = {"summary": "Summarise these criteria of a tender.", "risks": "Name the risks of this tender for a bidder.", "scoring": "Explain how offers are scored and where points are won.", "executive": "Write an executive summary of this tender."}
    return F.concat_ws("\n\n", F.lit(asked[task]), F.to_json(criteria), *more)


def keyword_extractor(terms: tuple[str, ...]) -> Provider:
    """Stands in for a model that extracts: a JSON object with the sentences of the document that hold each term."""

    def one(prompt: str) -> str:
        sentences = [s.strip() for s in prompt.partition("\n\n")[2].replace("\n", " ").split(".") if s.strip()]
        found = {t: [s for s in sentences if t in s.lower()] for t in terms}
        return json.dumps({t: s for t, s in found.items() if s}, ensure_ascii=False, sort_keys=True)

    return lambda prompts: [one(p) for p in prompts]


extract_pcap, extract_ppt = keyword_extractor(PCAP_TERMS), keyword_extractor(PPT_TERMS)


def outline(prompts: list[str]) -> list[str]:
    """Stands in for a model that writes: the task and the names of the fields that hold something."""

    def one(prompt: str) -> str:
        task, _, rest = prompt.partition("\n\n")
        try:
            fields = [k for k, v in json.loads(rest.partition("\n\n")[0] or "{}").items() if v not in (None, "", [], {})]
        except ValueError:
            fields = []
        return f"{task} {', '.join(fields)}".strip()

    return [one(p) for p in prompts]


class Answers:
    """A model that answers prompts; this one judges a profile by the share of its terms that the text holds."""

    def match(self, text: str, terms: list[str]) -> dict:
        hit = [t for t in terms if t.lower() in (text or "").lower()]
        share = len(hit) / len(terms) if terms else 0.0
        verdict = "YES" if share >= 0.6 else "MAYBE" if share >= 0.3 else "NO"
        return {"verdict": verdict, "reason": f"{len(hit)} of {len(terms)} requirements found", "requirements": [{"name": t, "met": t in hit} for t in terms]}


ANALYSIS = "struct<verdict:string,reason:string,requirements:array<struct<name:string,met:boolean>>>"


def analyze(df: DataFrame, terms: list[str], text: str = "text", answers: Answers | None = None) -> DataFrame:
    """df with verdict (YES, MAYBE or NO), reason and requirements of a profile against each text."""
    model = answers or Answers()
    out = ask(df, text, lambda texts: [model.match(t, terms) for t in texts], "__match", ANALYSIS)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "__match.*")
