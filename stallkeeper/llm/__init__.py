"""Operations of a training-data pipeline, each on whole documents."""
