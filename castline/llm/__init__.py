"""Training-data operators: tokenizers, packing, filters, language, media and near-duplicate joins."""
