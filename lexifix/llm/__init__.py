"""Operations of a training-data pipeline: sharding, mixing, quality, language models, search, packing, near duplicates, archives, token stores."""
