"""Train the span finder: python -m ledgerloom.llm.pii_train --data DIR [--notes N] [--epochs N] [--resume]

Names, streets and towns that fill the sentences come from DIR/clients.parquet (at most 20,000 rows, the
bound on what training reads), everyday words from whole words of public vocabularies; the weights go to pii_weights.npz in
this folder. --resume starts from the weights that stand there.
"""

from __future__ import annotations

import argparse
import base64
import io
import pkgutil
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

from ledgerloom.llm.address_parts import parse
from ledgerloom.llm.bilstm_crf import Tagger, encode
from ledgerloom.llm.pii import TAGS, tags_of
from ledgerloom.llm.pii_corpus import notes
from ledgerloom.llm.tokens import VOCABULARY

ROWS = 20_000


def fillers(data: str) -> tuple[list[str], list[str], list[str], list[str]]:
    c = pd.read_parquet(f"{data}/clients.parquet", columns=["first_name", "last_name", "address_line1", "city", "state", "zip"]).head(ROWS)
    firsts = sorted(set(c.first_name.str.strip().str.title()))
    lasts = sorted(set(c.last_name.dropna().str.strip()) - {x for x in c.last_name.dropna() if x.isupper() or x.islower()})
    parsed = [parse(*r) for r in c[["address_line1", "city", "state", "zip"]].dropna(subset=["address_line1"]).values.tolist()]
    streets = sorted({a.street.split()[0] for a in parsed if a.street and not a.street[0].isdigit()})
    return firsts, lasts, streets, sorted({a.town for a in parsed if a.town})


def everyday(paths: list[str]) -> list[str]:
    """Small-letter words of three letters or more that are one token, space before, in a byte-pair vocabulary."""
    out: set[str] = set()
    for path in paths:
        with open(path, "rb") as f:
            tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            out |= {t[1:].decode() for t in tokens if t[:1] == b" " and t[1:].isalpha() and t[1:].islower() and 3 <= len(t) - 1 <= 14}
    return sorted(out)


def batches(examples, size: int, epochs: int, seed: int = 5):
    g = np.random.default_rng(seed)
    total, done = epochs * (len(examples) // size), 0
    for _ in range(epochs):
        order = sorted(range(len(examples)), key=lambda i: (len(examples[i][0]) // 24, g.random()))
        groups = [order[k : k + size] for k in range(0, len(order) - size + 1, size)]
        g.shuffle(groups)
        for group in groups:
            part = [examples[i] for i in group]
            lengths = np.array([len(t) for t, _ in part])
            ids, tags = np.zeros((lengths.max(), size), np.int64), np.zeros((lengths.max(), size), np.int64)
            for b, (t, spans) in enumerate(part):
                ids[: len(t), b], tags[: len(t), b] = encode(t), tags_of(len(t), spans)
            yield ids, lengths, tags, 1.0 - 0.9 * done / total
            done += 1


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--data", required=True)
    ap.add_argument("--notes", type=int, default=16_000)
    ap.add_argument("--epochs", type=int, default=3)
    ap.add_argument("--hidden", type=int, default=48)
    ap.add_argument("--rate", type=float, default=0.004)
    ap.add_argument("--seed", type=int, default=1)
    ap.add_argument("--resume", action="store_true")
    ap.add_argument("--vocabulary", nargs="*", default=[VOCABULARY, VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")])
    args = ap.parse_args()
    examples = list(notes(args.notes, *fillers(args.data), seed=args.seed, words=everyday(args.vocabulary)))
    model, start = Tagger.new(len(TAGS), hidden=args.hidden), time.time()
    if args.resume:
        with np.load(io.BytesIO(pkgutil.get_data("ledgerloom.llm", "pii_weights.npz"))) as z:
            model = Tagger({k: z[k].astype(np.float32) for k in z.files})
    model.train(batches(examples, 64, args.epochs), rate=args.rate, say=lambda n, loss: n % 50 == 0 and print(n, round(loss, 3), f"{time.time() - start:.0f} s", file=sys.stderr, flush=True))
    np.savez_compressed(Path(__file__).with_name("pii_weights.npz"), **{k: v.astype(np.float16) for k, v in model.p.items()})


if __name__ == "__main__":
    main()
