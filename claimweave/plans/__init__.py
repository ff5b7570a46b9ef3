"""claimweave.plans"""
