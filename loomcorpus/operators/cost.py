"""Cost of a model as column arithmetic over a table of configurations.

Columns: matmul (weights that multiply tokens), head (those of the last layer), ref (those that see references only),
width (heads times head size), seq, refs (reference tokens of a row), ref_len, cross (layers that attend to
references), enc_layers; windows: the attention window of each layer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplications of a weight in a training step; of an attention score; the batch of the model that others are scaled from.
TRAIN, SCORE, BATCH, POWER = 6, 12, 2**19, 0.383


def _attention(windows: Column, length: Column, per: int) -> Column:
    """Per token, over the layers' windows, none of which is longer than the text."""
    return F.aggregate(windows, F.lit(0.0), lambda a, w: a + F.least(w, length) * per * F.col("width"))


def train_flops(mode: Column) -> Column:
    """Operations of training for each predicted token. Mode none: the text alone. prefix: references stand before the text, and
    pass through all but the last layer with it. encoder: they are encoded once a row, and attended to."""
    grow = (F.col("seq") + F.col("refs")) / F.col("seq")
    share = F.col("refs") / F.col("seq")
    alone = TRAIN * F.col("matmul") + _attention(F.col("windows"), F.col("seq"), SCORE)
    prefix = TRAIN * ((F.col("matmul") - F.col("head")) * grow + F.col("head")) + grow * _attention(F.col("windows"), F.col("seq") + F.col("refs"), SCORE)
    apart = SCORE * F.col("width") * (F.col("refs") * F.col("cross") + F.col("ref_len") * F.col("enc_layers") * share)
    encoder = TRAIN * (F.col("matmul") - F.col("ref") + F.col("ref") * share) + _attention(F.col("windows"), F.col("seq"), SCORE) + apart
    return F.when(mode == "prefix", prefix).when(mode == "encoder", encoder).otherwise(alone)


def decode_flops(context: Column) -> Column:
    """Operations of one more token after `context` tokens; references are in the cache."""
    return 2 * (F.col("matmul") - F.col("ref")) + _attention(F.col("windows"), context, 4) + 4 * F.col("width") * F.col("refs") * F.col("cross")


def batch_tokens(tokens: Column, tokens_of_base: Column) -> Column:
    """The batch for a horizon of `tokens`: it grows with their power, rounded (half to even) to a power of two."""
    return F.pow(F.lit(2.0), F.bround(F.log2(F.lit(float(BATCH)) * F.pow(tokens / tokens_of_base, F.lit(POWER))), 0)).cast("long")


def rate_scale(batch: Column) -> Column:
    return F.sqrt(batch / F.lit(float(BATCH)))


def decay_scale(batch: Column, tokens: Column, tokens_of_base: Column) -> Column:
    return rate_scale(batch) * tokens_of_base / tokens


def momentum(step: Column, steps: int, down: float) -> Column:
    """0.85 to 0.97 over the first 400 steps, 0.97, then down to 0.90 over the last share."""
    start, most = steps - round(down * steps), float(max(1, round(down * steps)))
    return F.when(step < 400, 0.85 + (step / 400.0) * (0.97 - 0.85)).when(step >= start, 0.97 - (step - start) / most * (0.97 - 0.90)).otherwise(0.97)


def weight_decay(step: Column, steps: int, scaled: float) -> Column:
    """Half a cosine, from `scaled` to 0."""
    return F.lit(scaled / 2) * (1 + F.cos(F.lit(3.141592653589793) * step / steps))


def prefill_flops(tokens: Column) -> Column:
    """Operations of reading a prompt: token t attends to as many as a layer's window lets it, so a layer's sum ramps up and then stays."""
    def seen(w: Column) -> Column:
        full = F.least(w, tokens)
        return full * (full + 1) / 2 + (tokens - full) * full

    own = F.aggregate("windows", F.lit(0.0), lambda a, w: a + 4.0 * F.col("width") * seen(w))
    apart = 4.0 * F.col("width") * F.col("refs") * (F.col("cross") * tokens + F.col("ref_len") * F.col("enc_layers"))
    return 2 * (F.col("matmul") - F.col("ref")) * tokens + 2 * F.col("ref") * F.col("refs") + own + apart


def kv_bytes(layers: Column, kv_width: Column, element: int = 2) -> Column:
    """Bytes that one token's keys and values take in the cache, over all layers; kv_width: heads of the cache times their size."""
    return layers * 2 * kv_width * element


def kv_read(context: Column, kv_width: Column, element: int = 2) -> Column:
    """Bytes of the cache that one decoding step reads: each layer as far back as its window goes."""
    return F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.least(w, context).cast("long")) * 2 * kv_width * element
