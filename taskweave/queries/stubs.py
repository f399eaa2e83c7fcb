"""Model clients whose answer is a pure function of the prompt, so that runs can be compared."""

from __future__ import annotations

import hashlib
import json
import re


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def echo_client():
    """``n`` texts made from the prompt's hash."""
    return lambda prompt, n, temperature, max_tokens: [f"{md5(prompt)}~{i}" for i in range(n)]


def transform_client():
    """Row prompts get a JSON pair, some of it unusable; other prompts get a short text."""

    def ask(prompt, n, temperature, max_tokens):
        h = md5(prompt)
        if not prompt.endswith("Example as JSON:"):
            return [f"text {h}"]
        if h[0] == "0":
            return ["no object here"]
        return ["Result: " + json.dumps({"input": "" if h[0] == "1" else h, "output": h[:4]})]

    return ask


def parse_client():
    def ask(prompt, n, temperature, max_tokens):
        h = md5(prompt)
        return ["{broken" if h[0] == "f" else "So:\n" + json.dumps({"Instruction": f" {h} ", "Demonstrations": "N/A"})]

    return ask


def imagine_client():
    return lambda prompt, n, temperature, max_tokens: [f"A model about {md5(prompt)}."]


def columns_client():
    def ask(prompt, n, temperature, max_tokens):
        kind = md5(prompt)[0]
        output = {"0": [], "1": ["lang", "source"], "2": ["tone"]}.get(kind, ["lang"])
        return [json.dumps({"input": ["text"], "output": output, "irrelevant": ["doc_id"]})]

    return ask


def choose_client():
    """Each vote picks one of the names shown between double stars."""

    def ask(prompt, n, temperature, max_tokens):
        names = re.findall(r"\] \*\*([^*\n]+)\*\*", prompt)
        return [f"I take **{names[int(md5(f'{prompt}~{i}')[:15], 16) % len(names)]}**." for i in range(n)]

    return ask


def pair_client():
    """Few different inputs with disagreeing outputs, so that votes matter; some answers are unusable."""

    def ask(prompt, n, temperature, max_tokens):
        out = []
        for i in range(n):
            h = md5(f"{prompt}~{i}")
            out.append("not json" if h[0] == "0" else json.dumps({"input": f"case {int(h[1:4], 16) % 40}", "output": h[4] if h[4] < "8" else "x"}))
        return out

    return ask


def dataset_client():
    """Serves a whole dataset retrieval: votes, column choice, plan and row answers."""
    choose, transform = choose_client(), transform_client()

    def ask(prompt, n, temperature, max_tokens):
        if prompt.endswith("is:"):
            return choose(prompt, n, temperature, max_tokens)
        if prompt.endswith("Chosen columns:"):
            return [json.dumps({"input": ["text"], "output": ["source"], "irrelevant": ["doc_id"], "ambiguous": []})]
        return transform(prompt, n, temperature, max_tokens)

    return ask


def loud_model():
    return lambda texts: [t.replace("e", "E") for t in texts]


def shape_model():
    import numpy as np

    return lambda texts: np.array([[float(len(t)), float(t.count("e")), float(t.count("\n"))] for t in texts])
