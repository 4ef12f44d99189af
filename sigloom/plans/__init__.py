"""Ready-made plans: the queries of the driver contract and their SQL twins."""


def modules():
    """The modules that hold queries."""
    from sigloom.plans import identification, problems, registries, resultsets, vocabularies

    return [problems, identification, resultsets, registries, vocabularies]
