"""Jobs that prepare a training corpus: ten operators over whole tables."""
