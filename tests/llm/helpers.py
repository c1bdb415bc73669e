def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}
