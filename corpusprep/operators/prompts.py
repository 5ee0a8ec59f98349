"""Sequence builders (P0-P11) as per-row array expressions.

Every builder takes ``array<int>`` columns and returns a struct column
``(input_ids, mask, labels)`` (fields absent where the task has none). They
are narrow projections: no shuffle, fully parallel, whole-stage friendly.

``max_text_len`` is the configured text length ``L``; like the reference,
the task-token builders work with ``L + 1`` (t2i) or ``L`` (mmu, r2i).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _lit_arr(*xs: int) -> Column:
    return F.array(*[F.lit(int(x)) for x in xs])


def _rep(v: int, n: Column) -> Column:
    return F.array_repeat(F.lit(int(v)), F.greatest(n, F.lit(0)).cast("int"))


def _empty_int() -> Column:
    return F.array().cast("array<int>")


def with_bos(ids: Column, bos: int = K.BOS_ID) -> Column:
    """Empty -> [bos]; prepend bos when the first id is not bos."""
    ids = F.coalesce(ids.cast("array<int>"), _empty_int())
    return (F.when(F.size(ids) == 0, _lit_arr(bos))
            .when(F.get(ids, 0) != F.lit(bos), F.concat(_lit_arr(bos), ids))
            .otherwise(ids))


def last_position(ids: Column, value: int) -> Column:
    """0-based position of the last ``value`` in ``ids``, -1 if absent."""
    p = F.array_position(F.reverse(ids), F.lit(value))
    return F.when(p == 0, F.lit(-1)).otherwise(F.size(ids) - p).cast("int")


def _pad_or_cut_eos(t: Column, L: int, *, eos_on_cut: bool) -> Column:
    """Right-pad ``t`` with eos to L; if longer, cut to L (``eos_on_cut``: to
    L-1 then eos)."""
    n = F.size(t)
    cut = F.concat(F.slice(t, 1, L - 1), _lit_arr(K.EOS_ID)) if eos_on_cut else F.slice(t, 1, L)
    return F.when(n <= L, F.concat(t, _rep(K.EOS_ID, F.lit(L) - n))).otherwise(cut)


def lm_prompt(ids: Column, max_seq_len: int) -> Column:
    """bos/eos, right-padded with eos or plainly cut (no eos); the
    attention mask is all ones (it is computed after padding, X7)."""
    L = int(max_seq_len)
    seq = _pad_or_cut_eos(F.concat(with_bos(ids), _lit_arr(K.EOS_ID)), L, eos_on_cut=False)
    return F.struct(seq.alias("input_ids"), F.array_repeat(F.lit(1), F.size(seq)).alias("mask"),
                    seq.alias("labels"))


def lm_chat_prompt(ids: Column, max_seq_len: int) -> Column:
    """P6 sequence + prompt mask = 1 up to and including the last
    end-header (all 0 if none)."""
    L = int(max_seq_len)
    seq = _pad_or_cut_eos(F.concat(with_bos(ids), _lit_arr(K.EOS_ID)), L, eos_on_cut=False)
    plen = last_position(seq, K.END_HEADER_ID) + 1
    mask = F.concat(_rep(1, plen), _rep(0, F.size(seq) - plen))
    return F.struct(seq.alias("input_ids"), mask.alias("mask"), seq.alias("labels"))


def t2i_prompt(ids: Column, image: Column, max_text_len: int, *, image_labels: Column | None = None,
               drop: Column | None = None, with_labels: bool = True) -> Column:
    """``[t2i] bos text eos`` left-padded with iPAD to L+1 (or cut
    to L and eos), then ``[soi] image [eoi]``. ``drop`` (boolean) replaces
    the text by ``[t2i, bos, eos]`` (condition dropout). Labels: same with
    the image labels, iPAD -> -100."""
    Lp = int(max_text_len) + 1
    t = F.concat(_lit_arr(K.T2I_ID), with_bos(ids), _lit_arr(K.EOS_ID))
    if drop is not None:
        t = F.when(drop, _lit_arr(K.T2I_ID, K.BOS_ID, K.EOS_ID)).otherwise(t)
    n = F.size(t)
    n_img = F.size(image)
    text = F.when(n <= Lp, F.concat(_rep(K.PAD_ID, F.lit(Lp) - n), t)) \
            .otherwise(F.concat(F.slice(t, 1, Lp - 1), _lit_arr(K.EOS_ID)))
    mask = F.when(n <= Lp, F.concat(_rep(0, F.lit(Lp) - n), _rep(1, n + n_img + 2))) \
            .otherwise(_rep(1, F.lit(Lp) + n_img + 2))
    seq = F.concat(text, _lit_arr(K.SOI_ID), image.cast("array<int>"), _lit_arr(K.EOI_ID))
    fields = [seq.alias("input_ids"), mask.alias("mask")]
    if with_labels:
        lab_img = image if image_labels is None else image_labels
        lab = F.concat(text, _lit_arr(K.SOI_ID), lab_img.cast("array<int>"), _lit_arr(K.EOI_ID))
        lab = F.transform(lab, lambda x: F.when(x == F.lit(K.PAD_ID), F.lit(K.IGNORE_ID)).otherwise(x))
        fields.append(lab.alias("labels"))
    return F.struct(*fields)


def mmu_prompt(image: Column, ids: Column, max_text_len: int, *, with_labels: bool = True) -> Column:
    """``[mmu][soi] image [eoi]`` + bos text eos right-padded with eos
    to L (or cut to L-1 and eos). Prompt mask: image part plus text up to
    the last end-header (image part only if none). Labels -100 on the first
    ``n_img + 3`` positions."""
    L = int(max_text_len)
    text = _pad_or_cut_eos(F.concat(with_bos(ids), _lit_arr(K.EOS_ID)), L, eos_on_cut=True)
    img = image.cast("array<int>")
    head = F.concat(_lit_arr(K.MMU_ID, K.SOI_ID), img, _lit_arr(K.EOI_ID))
    seq = F.concat(head, text)
    eh = last_position(text, K.END_HEADER_ID)
    plen = F.size(head) + F.when(eh >= 0, eh + 1).otherwise(F.lit(0))
    mask = F.concat(_rep(1, plen), _rep(0, F.size(seq) - plen))
    fields = [seq.alias("input_ids"), mask.alias("mask")]
    if with_labels:
        lab = F.concat(_rep(K.IGNORE_ID, F.size(head)), text)
        lab = F.transform(lab, lambda x: F.when(x == F.lit(K.PAD_ID), F.lit(K.IGNORE_ID)).otherwise(x))
        fields.append(lab.alias("labels"))
    return F.struct(*fields)


def r2i_prompt(image: Column, ids: Column, max_text_len: int) -> Column:
    """P10: ``[r2i]`` + text (L, eos padded / cut with eos) + ``[soi] image
    [eoi]``; prompt mask 1 on the task token, text up to the last
    end-header (all text if none), soi and eoi; labels = ids."""
    L = int(max_text_len)
    text = _pad_or_cut_eos(F.concat(with_bos(ids), _lit_arr(K.EOS_ID)), L, eos_on_cut=True)
    img = image.cast("array<int>")
    seq = F.concat(_lit_arr(K.R2I_ID), text, _lit_arr(K.SOI_ID), img, _lit_arr(K.EOI_ID))
    nt = F.size(text)
    eh = last_position(text, K.END_HEADER_ID)
    text_prompt = F.when(eh >= 0, eh + 1).otherwise(nt)
    mask = F.concat(_lit_arr(1), _rep(1, text_prompt), _rep(0, nt - text_prompt),
                    _lit_arr(1), _rep(0, F.size(img)), _lit_arr(1))
    return F.struct(seq.alias("input_ids"), mask.alias("mask"), seq.alias("labels"))


def molecule_question(selfies_ids: Column, question_ids: Column) -> Column:
    """``[mmu][som] selfies [eom][sot] question``."""
    return F.concat(_lit_arr(K.MMU_ID, K.SOM_ID), selfies_ids.cast("array<int>"),
                    _lit_arr(K.EOM_ID, K.BOS_ID), question_ids.cast("array<int>"))


def chat_wrap(ids: Column) -> Column:
    """P2 on already tokenised ids: bos id prepended."""
    return F.concat(_lit_arr(K.BOS_ID), ids.cast("array<int>"))


TASKS = ("t2i", "t2i_gen", "lm", "lm_chat", "mmu", "mmu_gen", "r2i")


def build_sequences(df: DataFrame, task_col: str, *, ids: str = "ids", image: str = "image",
                    max_text_len: int = 128, max_seq_len: int = 512,
                    drop: Column | None = None) -> DataFrame:
    """Dispatch each row to the builder named by ``task_col``; an
    unknown task fails the job (``raise_error``). One narrow projection: the
    rows are not regrouped."""
    i, im, task = F.col(ids), F.col(image), F.col(task_col)
    out = (F.when(task == "t2i", t2i_prompt(i, im, max_text_len, drop=drop))
           .when(task == "t2i_gen", t2i_prompt(i, im, max_text_len, with_labels=False)
                 .withField("labels", _empty_int()))
           .when(task == "lm", lm_prompt(i, max_seq_len))
           .when(task == "lm_chat", lm_chat_prompt(i, max_seq_len))
           .when(task == "mmu", mmu_prompt(im, i, max_text_len))
           .when(task == "mmu_gen", mmu_prompt(im, i, max_text_len, with_labels=False)
                 .withField("labels", _empty_int()))
           .when(task == "r2i", r2i_prompt(im, i, max_text_len))
           .otherwise(F.raise_error(F.concat(F.lit("unknown task: "), task)).cast(
               "struct<input_ids:array<int>,mask:array<int>,labels:array<int>>")))
    return df.withColumn("seq", out)
