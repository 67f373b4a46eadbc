"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from tidewheel.llm import align, bpe, caps, chat, decontam, lines, minhash, pii, quality, repair, secrets, toxicity, urls

QUERIES = {"op1_lines": lines.op1_lines, "op3_caps": caps.op3_caps, "op2_toxicity": toxicity.op2_toxicity, "op4_minhash": minhash.op4_minhash, "op5_urls": urls.op5_urls, "op6_decontaminate": decontam.op6_decontaminate, "op10_quality": quality.op10_quality, "op7_secrets": secrets.op7_secrets, "op8_bpe": bpe.op8_bpe, "op9_chat": chat.op9_chat, "op11_align": align.op11_align, "op12_pii": pii.op12_pii, "op13_repair": repair.op13_repair}
ORACLES = {"op3_caps": caps.SQL, "op4_minhash": minhash.SQL, "op5_urls": urls.SQL, "op7_secrets": secrets.SQL, "op9_chat": chat.SQL, "op12_pii": pii.SQL, "op13_repair": repair.SQL}
