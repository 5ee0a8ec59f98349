"""Fixed values that results depend on.

FIXED VALUES (must stay as written; they define the id space of every
sequence this library builds):

Reserved task/marker ids:
    <|soi|>   126084
    <|eoi|>   126085
    <|sov|>   126086
    <|eov|>   126087
    <|t2i|>   126088
    <|mmu|>   126089
    <|t2v|>   126090
    <|v2v|>   126091
    <|lvg|>   126092
    [iPAD]    126093
    <|r2i|>   126094
Mask id:               126336
Image code offset:     126349 (VQ code c becomes token c + 126349)
Ignored label:         -100

Ids chosen by this library for the corpus-built vocabulary (the
reference takes them from an external tokenizer): word ids are
0 .. 126079, then
    <|startoftext|>      126080  (bos)
    <|endoftext|>        126081  (eos)
    <|unk|>              126082  (unknown word)
    <|start_header_id|>  126346
    <|end_header_id|>    126347
    <|eot_id|>           126348
Molecule markers for question sequences:
    <|som|>  126095   <|eom|>  126096   <|sot|> = bos   <|eot|> = eos
"""

RESERVED = {
    "<|soi|>": 126084,
    "<|eoi|>": 126085,
    "<|sov|>": 126086,
    "<|eov|>": 126087,
    "<|t2i|>": 126088,
    "<|mmu|>": 126089,
    "<|t2v|>": 126090,
    "<|v2v|>": 126091,
    "<|lvg|>": 126092,
    "[iPAD]": 126093,
    "<|r2i|>": 126094,
}
MASK_ID = 126336
IMAGE_OFFSET = 126349
IGNORE_ID = -100

BOS_TOKEN, BOS_ID = "<|startoftext|>", 126080
EOS_TOKEN, EOS_ID = "<|endoftext|>", 126081
UNK_TOKEN, UNK_ID = "<|unk|>", 126082
START_HEADER_TOKEN, START_HEADER_ID = "<|start_header_id|>", 126346
END_HEADER_TOKEN, END_HEADER_ID = "<|end_header_id|>", 126347
EOT_TOKEN, EOT_ID = "<|eot_id|>", 126348
MASK_TOKEN = "<|mdm_mask|>"
SOM_TOKEN, SOM_ID = "<|som|>", 126095
EOM_TOKEN, EOM_ID = "<|eom|>", 126096

PAD_ID = RESERVED["[iPAD]"]
SOI_ID = RESERVED["<|soi|>"]
EOI_ID = RESERVED["<|eoi|>"]
T2I_ID = RESERVED["<|t2i|>"]
MMU_ID = RESERVED["<|mmu|>"]
R2I_ID = RESERVED["<|r2i|>"]

# Largest word id + 1: corpus vocabularies never reach the special range.
MAX_WORD_VOCAB = BOS_ID

SPECIAL_TOKENS = {
    **RESERVED,
    BOS_TOKEN: BOS_ID,
    EOS_TOKEN: EOS_ID,
    UNK_TOKEN: UNK_ID,
    MASK_TOKEN: MASK_ID,
    START_HEADER_TOKEN: START_HEADER_ID,
    END_HEADER_TOKEN: END_HEADER_ID,
    EOT_TOKEN: EOT_ID,
    SOM_TOKEN: SOM_ID,
    EOM_TOKEN: EOM_ID,
}

# Thinking-mode instruction prepended to prompts when flagged.
THINKING_PREFIX = (
    "You should first think about the reasoning process in the mind and then "
    "provide the user with the answer. The reasoning process is enclosed "
    "within <think> </think> tags, i.e. <think> reasoning process here "
    "</think> answer here\n"
)

# Person-tag scrub (C4): replacement words, in this order.
PERSON_WORDS = ("a person", "someone", "somebody")
