"""Fixed values shared by every operator.

Fixed values (must equal the reference's for right results):
special ids pad=0, bos=1, eos=2, unk=3; special pieces "<pad>", "<s>", "</s>", "<unk>";
word-boundary marker U+2581; unknown piece prints as " ⁇ " (U+2047 with a space each side);
seeds 1337 (data order) and 3407 (subset sampling); beam 4, length penalty 0.6;
max lengths 128/128; coverage 0.9995; min_delta 0.001; patience 5.
"""

PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
N_SPECIAL = 4

SPECIAL_PIECES = ["<pad>", "<s>", "</s>", "<unk>"]

WORD_MARK = "▁"
UNK_SURFACE = " ⁇ "

SEED_ORDER = 1337
SEED_SUBSET = 3407

MAX_SRC_LEN = 128
MAX_TGT_LEN = 128
BEAM_SIZE = 4
LEN_PENALTY = 0.6
CHAR_COVERAGE = 0.9995
MIN_DELTA = 0.001
PATIENCE = 5
