"""Jobs of several steps: tokenizers, sequence embeddings, classifiers, scoring."""
