"""A plain version of the pipeline, for small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_text_operators import plain_near_copies, plain_spans
from tokenizers import Tokenizer


def _good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    again = len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)})
    chars = sum(map(len, words))
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    dup = len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    capitals = sum(c.isupper() for c in text)
    return not (len(words) < 50 or 100 * again > 50 * len(words) or 4 * symbols > len(words) or 10 * dup > 3 * max(len(lines), 10) or chars > 20 * len(words) or 2 * capitals > chars)


def plain_pipeline(docs):
    """Digests of the final pieces, and the ids kept by each stage but the last."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = []
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    sizes.append({d for d, _ in rows})
    rows = [(d, t) for d, t in rows if _good(t)]
    sizes.append({d for d, _ in rows})
    first = set(plain_near_copies(rows).values())
    rows = [(d, t) for d, t in rows if d in first]
    sizes.append({d for d, _ in rows})
    sizes.append({d for d, _ in rows})
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    out = Counter()
    for d, t in rows:
        for a, b, k in reversed(plain_spans(t)):  # no text of the small table has other spans, or overlapping ones
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        ids = [*encode(t, add_special_tokens=False).ids, 2]
        first_piece = len(ids) % 1024 or 1024
        cuts = [0, *range(first_piece, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out, sizes
