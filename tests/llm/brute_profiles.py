import numpy as np

from sparkrecall.llm import langid


def profile(text):
    """The sum of a text's trigram vectors, letter by letter."""
    enc = langid.encoder(langid.DIM, langid.SEED)
    classes = [0] + [int(enc.classes[ord(c)]) for c in text] + [0]
    classes = [c for k, c in enumerate(classes) if c or not k or classes[k - 1]]
    out = np.zeros(langid.DIM)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        out += enc.first[a].astype(float) * enc.second[b] * enc.third[c]
    return out / (np.linalg.norm(out) or 1)
