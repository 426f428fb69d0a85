"""Plain versions of the index, the matching statistics and the parse, for small inputs."""


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def model_index(refs, k):
    real = {s[i : i + k] for r in refs for s in (r, revcomp(r)) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}
    ends = {x[1:] for x in real}
    padded = {x[:i].rjust(k, "$") for x in real if x[:-1] not in ends for i in range(k)} | {"$" * k}
    return sorted(real | padded, key=lambda x: x[::-1]), real


def model_ms(nodes, read, k):
    suffixes = {n[-i:] for n in nodes for i in range(1, k + 1) if "$" not in n[-i:]}
    return [max([n for n in range(1, min(k, p + 1) + 1) if read[p - n + 1 : p + 1] in suffixes], default=0) for p in range(len(read))]


def model_tokens(nodes, real, read, k):
    """Token lengths from the right, by walking base by base."""
    ms, out, p = model_ms(nodes, read, k), [], len(read) - 1
    while p >= 0:
        if ms[p] == k and p >= k + 1:
            run, kmer = 0, read[p - k + 1 : p + 1]
            while run < p - k:
                before = [c for c in "ACGT" if c + kmer[:-1] in real]
                at = p - k - run
                if len(before) != 1 or before[0] != read[at]:
                    break
                kmer, run = before[0] + kmer[:-1], run + 1
            length = k * ((k + run - 1) // k) + 1
        else:
            length = max(ms[p], 1)
        out.append(length)
        p -= length
    return out
