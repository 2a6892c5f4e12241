"""The training-data queries by name, with oracle SQL where SQL can express them."""

from lodestone.llm import ann, exact_dedup, jaccard_join, substring_dedup
from lodestone.llm.ann import op10_ann
from lodestone.llm.bpe import op2_bpe
from lodestone.llm.chat import op7_chat
from lodestone.llm.exact_dedup import op1_exact_dedup
from lodestone.llm.jaccard_join import op3_jaccard_join
from lodestone.llm.langid import op6_langid
from lodestone.llm.packing import op8_packing
from lodestone.llm.substring_dedup import op4_substring_dedup
from lodestone.llm.token_files import op9_token_files
from lodestone.llm.toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_bpe,
        op3_jaccard_join,
        op4_substring_dedup,
        op5_toxicity,
        op6_langid,
        op7_chat,
        op8_packing,
        op9_token_files,
        op10_ann,
    )
}

ORACLE_SQL = {"op1_exact_dedup": exact_dedup.ORACLE, "op3_jaccard_join": jaccard_join.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op10_ann": ann.ORACLE}
