"""Queries run the operators at the functions' own sizes."""

import inspect

import pytest

import __spark_entry__ as registered
from sigframe.plans import classifier, network, quantizer, skipgram

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    "name, owner, function, sizes",
    [
        ("tokenize", quantizer, "build_tokenizer", ["k", "iters"]),
        ("build_large_tokenizer", quantizer, "build_tokenizer", ["iters"]),
        ("build_tokenizer_full", quantizer, "build_tokenizer", ["k", "iters"]),
        ("build_pca_tokenizer_full", quantizer, "build_pca_tokenizer", ["k", "iters"]),
        ("save_model", quantizer, "build_pca_tokenizer", ["k", "iters"]),
        ("embed_word2vec", quantizer, "build_tokenizer", ["iters"]),
        ("embed_word2vec_full", quantizer, "build_tokenizer", ["k", "iters"]),
        ("train_word2vec", skipgram, "train_skipgram", ["window", "epochs", "negative", "ns_exponent", "sample"]),
        ("train_word2vec_full", skipgram, "train_skipgram", ["size", "window", "epochs", "negative", "ns_exponent", "sample"]),
        ("train_classifier", network, "train_relu_classifier", ["hidden", "epochs", "rate", "batch", "patience"]),
        ("evaluate", classifier, "train_classifier", ["hidden", "max_iter"]),
        ("train_boosted_trees", classifier, "train_boosted_trees", ["trees", "depth"]),
        ("search_params_full", classifier, "search_params", ["folds"]),
    ],
)
def test_query_leaves_sizes_to_the_function(spark, monkeypatch, name, owner, function, sizes):
    signature = inspect.signature(getattr(owner, function))

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen({s: bound.arguments[s] for s in sizes})

    monkeypatch.setattr(owner, function, record)
    with pytest.raises(Seen) as seen:
        registered.queries()[name](spark, SF)
    assert seen.value.args[0] == {s: signature.parameters[s].default for s in sizes}
