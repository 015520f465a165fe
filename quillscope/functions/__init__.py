"""Part of quillscope."""
