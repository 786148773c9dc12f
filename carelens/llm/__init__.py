"""Training-data operators: near-duplicates, repeats, secrets, chat text,
decontamination, token counts, language, quality, SentencePiece, HTML.

Nothing else in ``carelens`` imports this subpackage.
"""
