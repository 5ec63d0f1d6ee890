"""Which problem a target column poses, and three models trained and compared on it."""
