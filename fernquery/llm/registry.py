"""The queries of this subpackage, and the SQL of those that SQL can express."""

from fernquery.llm.collisions import op4_collisions
from fernquery.llm.contextmix import op10_contextmix
from fernquery.llm.linechunks import op2_linechunks
from fernquery.llm.mixing import op8_mixing
from fernquery.llm.nearcopies import op9_nearcopies
from fernquery.llm.orderhash import op5_orderhash
from fernquery.llm.packing import op3_packing
from fernquery.llm.quality import op7_quality
from fernquery.llm.suffixes import op6_suffixes
from fernquery.llm.transcripts import op1_transcripts

QUERIES = {
    "op1_transcripts": op1_transcripts,
    "op2_linechunks": op2_linechunks,
    "op3_packing": op3_packing,
    "op4_collisions": op4_collisions,
    "op5_orderhash": op5_orderhash,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_nearcopies": op9_nearcopies,
    "op10_contextmix": op10_contextmix,
}
ORACLES: dict[str, str] = {}
